"""Task graphs whose dependencies follow from what tasks read and write, and pools of independent tasks."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Task:
    """Reads the current version of ``reads`` and makes a new version of ``writes`` by ``run(*inputs)``; ``values`` come after."""

    name: str
    run: Callable[..., DataFrame]
    reads: tuple[str, ...] = ()
    writes: tuple[str, ...] = ()
    values: tuple = ()


@dataclass
class TaskGraph:
    """Tasks in the order they are submitted, and the edges that their tags imply.

    A read depends on the tag's last writer (RAW); a write on that writer's readers since (WAR) or, if nobody has read,
    on the writer (WAW). Datasets are immutable versions, so only RAW edges order the work; all are kept to be looked at.
    """

    tasks: list[Task] = field(default_factory=list)
    edges: list[tuple[str, str, str, str]] = field(default_factory=list)
    _writer: dict[str, str] = field(default_factory=dict)
    _readers: dict[str, list[str]] = field(default_factory=dict)

    def add(self, name: str, run: Callable[..., DataFrame], reads: tuple[str, ...] = (), writes: tuple[str, ...] = (), *values: object) -> TaskGraph:
        for tag in reads:
            if tag in self._writer:
                self._link(self._writer[tag], name, tag, "RAW")
            self._readers.setdefault(tag, []).append(name)
        for tag in writes:
            readers = self._readers.get(tag, [])
            for r in readers:
                self._link(r, name, tag, "WAR")
            if not readers and tag in self._writer:
                self._link(self._writer[tag], name, tag, "WAW")
            self._writer[tag], self._readers[tag] = name, []
        self.tasks.append(Task(name, run, reads, writes, values))
        return self

    def _link(self, before: str, after: str, tag: str, kind: str) -> None:
        edge = (before, after, tag, kind)
        if before != after and edge not in self.edges:
            self.edges.append(edge)

    def run(self, inputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """The last version of every dataset. Nothing is computed: the versions are plans, fused where Catalyst can."""
        now = dict(inputs)
        for t in self.tasks:
            made = t.run(*[now[r] for r in t.reads], *t.values)
            for tag, df in zip(t.writes, made if isinstance(made, tuple) else (made,), strict=True):
                now[tag] = df
        return now

    def execute(self, inputs: dict[str, DataFrame], action: Callable[[str, DataFrame], object], workers: int = 4) -> dict[str, object]:
        """``action(name, dataset)`` for each task's first output, as soon as the tasks it depends on have had theirs."""
        versions: dict[str, DataFrame] = {}
        now = dict(inputs)
        for t in self.tasks:
            made = t.run(*[now[r] for r in t.reads], *t.values)
            outs = made if isinstance(made, tuple) else (made,)
            now.update(zip(t.writes, outs, strict=True))
            versions[t.name] = outs[0]
        before = {t.name: {a for a, b, _, _ in self.edges if b == t.name} for t in self.tasks}
        done: dict[str, object] = {}
        running: dict[Future, str] = {}
        with ThreadPoolExecutor(workers) as pool:
            while len(done) < len(self.tasks):
                for t in self.tasks:
                    if t.name not in done and t.name not in running.values() and before[t.name] <= done.keys():
                        running[pool.submit(action, t.name, versions[t.name])] = t.name
                for f in wait(running, return_when=FIRST_COMPLETED).done:
                    done[running.pop(f)] = f.result()
        return done


def run_tasks(tasks: list[Callable[[], object]], workers: int = 4) -> list[object]:
    """Results of independent tasks (Spark actions), in the order given; all have ended when it returns."""
    with ThreadPoolExecutor(workers) as pool:
        return [f.result() for f in [pool.submit(t) for t in tasks]]


class AsyncKernel:
    """A kernel whose calls return at once: ``submit`` starts an action (with any arguments) and gives its Future."""

    def __init__(self, action: Callable[..., object], workers: int = 2) -> None:
        self.action, self.pool = action, ThreadPoolExecutor(workers)

    def submit(self, *arguments: object) -> Future:
        return self.pool.submit(self.action, *arguments)

    def __enter__(self) -> AsyncKernel:
        return self

    def __exit__(self, *_: object) -> None:
        self.pool.shutdown()
