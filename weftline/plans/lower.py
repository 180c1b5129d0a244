"""Lowering of logical graphs to DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.iterate import feedback
from weftline.plans.graph import AllToAll, Combined, Farm, Group, Node, Pipeline, Selector, Stage, validate


def run(node: Node, source: DataFrame) -> DataFrame:
    """The results of the graph over ``source`` as a lazy DataFrame.

    Farms are not dealt out: their workers are one transformation of all items, which Spark spreads over its tasks. Only
    where a graph routes items, by a farm's or an all-to-all's ``route``, is there a shuffle, and the worker's number
    stands in column ``worker``.
    """
    validate(node)
    return _lower(node, source)


def _lower(node: Node, df: DataFrame) -> DataFrame:
    match node:
        case Stage():
            return node.fn(df)
        case Combined():
            return _lower(node.second, _lower(node.first, df))
        case Selector():
            return _lower(node.alternatives[node.chosen], df)
        case Farm():
            if node.emitter:
                df = _lower(node.emitter, df)
            if node.route is not None:
                df = df.withColumn("worker", node.route.cast("int")).repartitionById(node.workers, F.col("worker"))
            df = _lower(node.worker, df)
            if node.ordered:
                df = df.orderBy("seq")
            return _lower(node.collector, df) if node.collector else df
        case Group():
            return _lower(node.pipeline(), df)
        case AllToAll():
            df = _lower(node.left, df)
            if node.route is not None:
                df = df.withColumn("worker", node.route.cast("int")).repartitionById(node.rights, F.col("worker"))
            return _lower(node.right, df)
        case Pipeline():
            if node.feedback:
                return _loop(node, df)
            for s in node.stages:
                df = _lower(s, df)
            return df
    raise TypeError(f"no graph node: {node!r}")


def _loop(node: Pipeline, df: DataFrame) -> DataFrame:
    """A wrapped-around pipeline: what leaves it is what ``until`` holds for, over all rounds."""
    body = Pipeline(node.stages)
    leaves = node.until if node.until is not None else F.lit(False)
    marked = df.withColumn("_out", F.lit(False))

    def again(front: DataFrame) -> DataFrame:
        made = _lower(body, front.where(~F.col("_out")).drop("_out"))
        return made.withColumn("_out", leaves)

    return feedback(marked, again).where("_out").drop("_out")
