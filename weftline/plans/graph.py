"""Logical graphs: immutable stages composed into pipelines, farms and all-to-alls, checked before anything runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

Transform = Callable[[DataFrame], DataFrame]


class TopologyError(ValueError):
    """The stages cannot be connected."""


@dataclass(frozen=True)
class Stage:
    """A sequential node. ``multi_in`` nodes take several channels, ``multi_out`` nodes choose among several."""

    fn: Transform
    name: str = "stage"
    takes: T.StructType | None = None
    gives: T.StructType | None = None
    multi_in: bool = False
    multi_out: bool = False


@dataclass(frozen=True)
class Combined:
    """Two sequential nodes as one: every item of the first goes straight to the second."""

    first: Node
    second: Node

    def change_first(self, node: Node) -> Combined:
        return replace(self, first=node)

    def change_last(self, node: Node) -> Combined:
        return replace(self, second=node)


@dataclass(frozen=True)
class Farm:
    """``workers`` replicas of a node. An ordered farm gives results in the order of its input (column ``seq``)."""

    worker: Node
    workers: int
    emitter: Stage | Combined | None = None
    collector: Stage | Combined | None = None
    has_collector: bool = True
    ordered: bool = False
    route: Column | None = None

    def change_emitter(self, node: Stage | Combined | None) -> Farm:
        return replace(self, emitter=node)

    def change_collector(self, node: Stage | Combined | None) -> Farm:
        return replace(self, collector=node, has_collector=True)

    def change_workers(self, worker: Node, workers: int | None = None) -> Farm:
        return replace(self, worker=worker, workers=workers or self.workers)


@dataclass(frozen=True)
class AllToAll:
    """Every left worker may send to every right worker; ``route`` (an int column expression) picks the right one."""

    left: Node
    lefts: int
    right: Node
    rights: int
    route: Column | None = None

    def change_firstset(self, left: Node, lefts: int | None = None) -> AllToAll:
        return replace(self, left=left, lefts=lefts or self.lefts)

    def change_secondset(self, right: Node, rights: int | None = None, route: Column | None = None) -> AllToAll:
        return replace(self, right=right, rights=rights or self.rights, route=self.route if route is None else route)


@dataclass(frozen=True)
class Pipeline:
    stages: tuple[Node, ...]
    feedback: bool = False
    until: Column | None = None

    def __post_init__(self) -> None:
        flat: list[Node] = []
        for s in self.stages:
            flat += s.stages if isinstance(s, Pipeline) and not s.feedback else [s]
        object.__setattr__(self, "stages", tuple(flat))

    def append(self, node: Node) -> Pipeline:
        return replace(self, stages=(*self.stages, node))

    def prepend(self, node: Node) -> Pipeline:
        return replace(self, stages=(node, *self.stages))

    def insert(self, at: int, node: Node) -> Pipeline:
        return replace(self, stages=(*self.stages[:at], node, *self.stages[at:]))

    def remove(self, at: int) -> Pipeline:
        return replace(self, stages=self.stages[:at] + self.stages[at + 1 :])

    def change(self, old: Node, new: Node) -> Pipeline:
        return replace(self, stages=tuple(new if s is old else s for s in self.stages))

    def wrap_around(self, until: Column | None = None) -> Pipeline:
        """The pipeline as a loop: items for which ``until`` holds leave it, all others return to the head."""
        return replace(self, feedback=True, until=until)


@dataclass(frozen=True)
class Selector:
    """Several alternatives of which one, ``chosen``, runs; ``select`` gives the node with another one chosen."""

    alternatives: tuple[Node, ...]
    chosen: int = 0

    def select(self, k: int) -> Selector:
        if not 0 <= k < len(self.alternatives):
            raise IndexError(k)
        return replace(self, chosen=k)


@dataclass(frozen=True)
class Group:
    """A name for nodes, one after another, that should run together. It is a hint: results are the same with it and without."""

    name: str
    nodes: tuple[Node, ...] = field(default=())

    def __lshift__(self, node: Node) -> Group:
        return replace(self, nodes=(*self.nodes, node))

    def pipeline(self) -> Pipeline:
        return Pipeline(self.nodes)


Node = Stage | Combined | Farm | AllToAll | Pipeline | Selector | Group


def kernel(form: str, *stages: Stage, workers: int = 1) -> Node:
    """The stages as one kernel: a ``pipe``, or a ``farm`` or ``ordered`` farm whose workers run them one after another."""
    if form == "pipe":
        return Pipeline(stages)
    worker: Node = stages[0]
    for s in stages[1:]:
        worker = Combined(worker, s)
    if form not in ("farm", "ordered"):
        raise ValueError(form)
    return Farm(worker, workers, ordered=form == "ordered")


def outputs(node: Node) -> int:
    """How many channels a node's results leave by."""
    match node:
        case Farm():
            return 1 if node.has_collector or node.collector else node.workers
        case AllToAll():
            return node.rights
        case Pipeline():
            return outputs(node.stages[-1])
        case Selector():
            return outputs(node.alternatives[node.chosen])
        case Group():
            return outputs(node.nodes[-1])
        case _:
            return 1


def inputs(node: Node) -> int:
    match node:
        case AllToAll():
            return node.lefts
        case Pipeline():
            return inputs(node.stages[0])
        case Selector():
            return inputs(node.alternatives[node.chosen])
        case Group():
            return inputs(node.nodes[0])
        case _:
            return 1


def first(node: Node) -> Node:
    match node:
        case Pipeline():
            return first(node.stages[0])
        case Combined():
            return first(node.first)
        case Group():
            return first(node.nodes[0])
        case _:
            return node


def last(node: Node) -> Node:
    match node:
        case Pipeline():
            return last(node.stages[-1])
        case Combined():
            return last(node.second)
        case Group():
            return last(node.nodes[-1])
        case _:
            return node


def _multi_in(node: Node) -> bool:
    node = first(node)
    return isinstance(node, Farm) or (isinstance(node, Stage) and node.multi_in) or (isinstance(node, AllToAll) and _multi_in(node.left))


def _multi_out(node: Node) -> bool:
    node = last(node)
    if isinstance(node, Farm):
        return not node.has_collector and _multi_out(node.worker)
    return (isinstance(node, Stage) and node.multi_out) or (isinstance(node, AllToAll) and _multi_out(node.right))


def connection(before: Node, after: Node) -> str:
    """How two neighbours are connected: fifo, gather, routed, pairwise (no shuffle) or bipartite (one shuffle)."""
    a, b = outputs(before), inputs(after)
    if isinstance(after, AllToAll):
        if a == 1:
            if b > 1 and not _multi_out(before):
                raise TopologyError("one sequential stage cannot feed several left workers unless it is multi-output")
            return "routed" if b > 1 else "fifo"
        if _multi_out(before) and _multi_in(after):
            return "bipartite"
        if a != b:
            raise TopologyError(f"{a} workers cannot be paired with {b}")
        return "pairwise"
    if a > 1:
        if not _multi_in(after):
            raise TopologyError("several channels need a multi-input stage")
        return "gather"
    return "fifo"


def validate(node: Node) -> None:
    """Raise TopologyError or TypeError unless the graph can be connected as it stands."""
    match node:
        case Pipeline():
            if not node.stages:
                raise TopologyError("an empty pipeline")
            for s in node.stages:
                validate(s)
            for a, b in zip(node.stages, node.stages[1:], strict=False):
                connection(a, b)
                _check_types(a, b)
            if node.feedback:
                _check_feedback(node)
        case Farm():
            if node.workers < 1:
                raise TopologyError("a farm needs a worker")
            if node.ordered and not isinstance(node.worker, Stage | Combined):
                raise TopologyError("workers of an ordered farm are sequential nodes")
            validate(node.worker)
        case AllToAll():
            for side in (node.left, node.right):
                if isinstance(side, Farm | AllToAll):
                    raise TopologyError("a farm or all-to-all cannot be a worker of an all-to-all")
                validate(side)
            if node.lefts < 1 or node.rights < 1:
                raise TopologyError("an all-to-all needs workers on both sides")
        case Combined():
            for part in (node.first, node.second):
                if not isinstance(part, Stage | Combined):
                    raise TopologyError("only sequential nodes can be combined")
                validate(part)
            _check_types(node.first, node.second)
        case Selector():
            for s in node.alternatives:
                validate(s)
        case Group():
            validate(node.pipeline())


def _check_feedback(node: Pipeline) -> None:
    head, tail = node.stages[0], node.stages[-1]
    a, b = outputs(tail), inputs(head)
    if isinstance(head, AllToAll):
        if a == 1 and not _multi_out(tail):
            raise TopologyError("a sequential last stage must be multi-output to feed an all-to-all back")
        if a > 1 and _multi_out(tail) and not _multi_in(head):
            raise TopologyError("left workers that are fed back by several channels must be multi-input")
        if a > 1 and not _multi_out(tail) and a != b:
            raise TopologyError(f"{a} workers cannot be paired with {b}")
    elif a > 1 and not _multi_in(head):
        raise TopologyError("several channels cannot be fed back to a single-input stage")


def _check_types(a: Node, b: Node) -> None:
    x, y = last(a), first(b)
    if isinstance(x, Stage) and isinstance(y, Stage) and x.gives is not None and y.takes is not None:
        given = {f.name: f.dataType for f in x.gives}
        for f in y.takes:
            if given.get(f.name) != f.dataType:
                raise TypeError(f"{y.name} takes {f.name} {f.dataType.simpleString()}, which {x.name} does not give")
