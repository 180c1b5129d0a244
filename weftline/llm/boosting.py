"""Gradient-boosted trees for binary labels, small enough to be trained on the driver from a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    """Trees of ``depth`` levels on quantile bins, fitted to the log loss, with Platt calibration on rows held out."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.25
    bins: int = 32
    l2: float = 1.0
    #: rows that are scored at a time, so that they stay in the processor's cache
    chunk: int = 4096
    edges: list[np.ndarray] = field(default_factory=list)
    #: per tree: (feature, bin) of the inner nodes in level order, and the leaves' values
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    start: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b, mean = self._bin(x), np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = p - y, p * (1 - p)
            node, feats, cuts = np.zeros(len(y), np.int64), [], []
            for level in range(self.depth):
                width = 1 << level
                best = np.full(width, -np.inf)
                pick, cut = np.zeros(width, np.int64), np.full(width, self.bins + 1)
                for k in range(b.shape[1]):
                    at = node * (self.bins + 1) + b[:, k]
                    g = np.bincount(at, grad, width * (self.bins + 1)).reshape(width, -1).cumsum(1)
                    h = np.bincount(at, hess, width * (self.bins + 1)).reshape(width, -1).cumsum(1)
                    gain = g**2 / (h + self.l2) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + self.l2) - g[:, -1:] ** 2 / (h[:, -1:] + self.l2)
                    c = gain.argmax(1)
                    better = gain[np.arange(width), c] > best + 1e-9
                    best[better], pick[better], cut[better] = gain[np.arange(width), c][better], k, c[better]
                feats.append(pick)
                cuts.append(cut)
                node = 2 * node + (b[np.arange(len(y)), pick[node]] > cut[node])
            leaves = 1 << self.depth
            value = -self.rate * np.bincount(node, grad, leaves) / (np.bincount(node, hess, leaves) + self.l2)
            self.trees.append((np.concatenate(feats), np.concatenate(cuts), value))
            score += value[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._raw(x[at : at + self.chunk]) for at in range(0, max(1, len(x)), self.chunk)])

    def _raw(self, x: np.ndarray) -> np.ndarray:
        wide = x.shape[1]
        b, score, row = self._bin(x).astype(np.uint8).ravel(), np.full(len(x), self.start), np.arange(len(x)) * wide
        for feats, cuts, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = node + ((1 << level) - 1)
                node = 2 * node + (b[row + feats[at]] > cuts[at])
            score += value[node]
        return score

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Fit ``sigmoid(a * raw + b)`` to rows that the trees have not seen."""
        s, a, b = self.raw(x), 1.0, 0.0
        for _ in range(50):  # Newton steps on two parameters, slightly damped
            p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
            w = p * (1 - p) + 1e-6
            grad = np.array([((p - y) * s).sum() + 1e-3 * (a - 1), (p - y).sum()])
            hess = np.array([[(w * s * s).sum() + 1e-3, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(hess, grad)
            a, b = a - float(step[0]), b - float(step[1])
        self.scale = (a, b)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * self.raw(x) + self.scale[1], -30, 30)))
