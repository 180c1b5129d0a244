"""Token ids of whole texts by a public tokenizer, with words encoded once.

The vocabulary ``word_bpe_49k`` splits at white space and never merges across it, so the ids of a text are those of its
words. A worker keeps the ids of the words that it has met; new ones are encoded many at a
time by the vocabulary's merge rules.
Texts with characters that normalisation might change go to the tokenizer itself.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"
#: Words kept by a worker; when so many are there, further ones are encoded and not kept.
CACHE_WORDS = 600_000
#: Bytes of a piece of a word above which the tokenizer itself encodes it.
LONG_PIECE = 200
#: Letters of ASCII and Latin that are their own normal form; anything else takes the slow path.
_ODD = r"[^\t-\r -~À-ÖØ-öø-įĲ-ňŊ-ž–—‘-”…€]"
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _values(strings: pa.Array) -> list[bytes]:
    data = strings.buffers()[2]
    data = data.to_pybytes() if data is not None else b""
    at = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].tolist() if len(strings) else [0]
    return [data[a:b] for a, b in pairwise(at)]


_NEVER = np.iinfo(np.int32).max


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordEncoder:
    """Ids of texts; words are kept as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        shown = _byte_letters()
        self.inner = np.array([vocab[c] for c in shown], np.int32)
        self.last = np.array([vocab[f"{c}</w>"] for c in shown], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[x] << 32 | vocab[y] for x, y in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[x + y] for x, y in pairs], np.int32)
        self.words: dict[bytes, bytes] = {}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of merging ids ``a`` and ``b``, _NEVER where no rule does."""
        pair = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], _NEVER)

    def _merge(self, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Byte-pair encoding of many pieces of one length at once: in each round every row does its best merge.

        ``ids`` has a piece's symbols in each row; gives (rows, their ids) for each length that rows end with.
        """
        rows, done = np.arange(len(ids)), []
        rank = self._rank(ids[:, :-1], ids[:, 1:])
        while ids.shape[1] > 1 and len(rows):
            at = rank.argmin(1)
            best = rank[np.arange(len(rows)), at]
            ready = best == _NEVER
            if ready.any():
                done.append((rows[ready], ids[ready]))
                go = ~ready
                rows, ids, rank, at, best = rows[go], ids[go], rank[go], at[go], best[go]
            k, cols = np.arange(len(rows)), np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, cols + (cols > at[:, None]), 1)
            ids[k, at] = self.made[best]
            rank = np.take_along_axis(rank, (cols + (cols >= at[:, None]))[:, :-1], 1)
            left, right = at > 0, at < ids.shape[1] - 1
            rank[k[left], at[left] - 1] = self._rank(ids[k[left], at[left] - 1], ids[k[left], at[left]])
            rank[k[right], at[right]] = self._rank(ids[k[right], at[right]], ids[k[right], at[right] + 1])
        done.append((rows, ids))
        return done

    def _learn_pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out: dict[bytes, bytes] = {}
        for n in np.unique(sizes).tolist():
            group = np.flatnonzero(sizes == n)
            if n > LONG_PIECE:  # one by one: rounds over long rows would cost their length squared
                for i in group.tolist():
                    out[pieces[i]] = np.array(self.full.encode(pieces[i].decode(), add_special_tokens=False).ids, "<u4").tobytes()
                continue
            symbols = np.frombuffer(b"".join([pieces[i] for i in group.tolist()]), np.uint8).reshape(-1, n)
            ids = self.inner[symbols]
            ids[:, -1] = self.last[symbols[:, -1]]
            for rows, found in self._merge(ids):
                flat, width = found.astype("<u4").tobytes(), 4 * found.shape[1]
                for k, i in enumerate(group[rows].tolist()):
                    out[pieces[i]] = flat[k * width : (k + 1) * width]
        return out

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        plain = [w for w in words if w.isalpha()]  # ASCII letters only: a piece of its own
        split = {w: [p.encode() for p in _PIECES.findall(w.decode())] for w in words if not w.isalpha()}
        found = self._learn_pieces(list({*plain, *(p for ps in split.values() for p in ps)}))
        out = {w: found[w] for w in plain}
        for w, ps in split.items():
            out[w] = found[ps[0]] if len(ps) == 1 else b"".join([found[p] for p in ps])
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one row (uint32), without special tokens, and how many each text has. Null is empty."""
        gc.disable()  # millions of short-lived strings, no cycles
        try:
            return self._encode(pc.fill_null(texts.cast(pa.string()), ""))
        finally:
            gc.enable()

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = np.array(pc.or_(pc.match_substring_regex(texts, _ODD), pc.match_substring(texts, "<|")))
        low = pc.utf8_lower(texts.filter(pa.array(~odd)))
        lists = pc.ascii_split_whitespace(low)
        sizes = np.array(pc.list_value_length(lists), np.int64)
        flat = lists.flatten()
        there = np.array(pc.not_equal(flat, ""), bool)  # white space at either end leaves an empty one
        coded = flat.filter(pa.array(there)).dictionary_encode()
        words, known = _values(coded.dictionary), self.words
        fresh = self._learn([w for w in words if w not in known])
        known.update(fresh)
        each = list(map(known.__getitem__, words))
        if len(known) > CACHE_WORDS:
            for w in fresh:
                del known[w]
        lengths = np.fromiter(map(len, each), np.int64, len(each)) // 4
        bank, begins = np.frombuffer(b"".join(each), "<u4"), np.cumsum(lengths) - lengths
        codes = np.array(coded.indices, np.int64)
        counts = lengths[codes]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = bank[np.repeat(begins[codes] - ends + counts, counts) + np.arange(total)]
        row = np.repeat(np.arange(len(sizes)), sizes)[there]
        plain = np.bincount(row, counts, len(sizes)).astype(np.int64)
        if not odd.any():
            return ids, plain
        n = np.zeros(len(texts), np.int64)
        n[~odd] = plain
        slow = [np.array(self.full.encode(t.as_py(), add_special_tokens=False).ids, np.uint32) for t in texts.filter(pa.array(odd))]
        n[odd] = [len(x) for x in slow]
        parts, at, rest = [], np.concatenate([[0], np.cumsum(plain)]), iter(slow)
        seen = 0
        for is_odd in odd.tolist():
            parts.append(next(rest) if is_odd else ids[at[seen] : at[seen + 1]])
            seen += not is_odd
        return np.concatenate(parts), n


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def slices(texts: pa.Array, most: int = 12_000_000) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of rows of about ``most`` bytes, at least one row each: what is worked on at a time stays bounded."""
    size = np.cumsum(np.array(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    begin = 0
    while begin < len(size):
        end = int(np.searchsorted(size, (size[begin - 1] if begin else 0) + most, "right"))
        yield begin, (end := max(end, begin + 1))
        begin = end
