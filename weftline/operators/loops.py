"""Indexed loops, their schedules, and reductions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def indices(spark: SparkSession, first: int, last: int, step: int = 1, grain: int = 0) -> DataFrame:
    """(k, idx): the indices ``first, first + step, ...`` below ``last`` (above it for a negative step), numbered from 0.

    A positive grain makes partitions of that many indices, as far as it can.
    """
    count = max(0, -(-(last - first) // step))
    parts = max(1, min(10_000, -(-count // grain))) if grain > 0 else None
    rows = spark.range(0, count, 1, parts) if parts else spark.range(count)
    return rows.select(F.col("id").alias("k"), (F.col("id") * step + first).alias("idx"))


def parallel_for(spark: SparkSession, first: int, last: int, body: dict[str, str | Column], step: int = 1, grain: int = 0) -> DataFrame:
    """The loop's indices with what ``body`` computes from ``idx``."""
    return indices(spark, first, last, step, grain).withColumns({k: F.expr(v) if isinstance(v, str) else v for k, v in body.items()})


def with_thread(df: DataFrame, name: str = "_thid") -> DataFrame:
    """``df`` with the number of the task that works on the item: which it is says nothing, what is summed over it does."""
    return df.withColumn(name, F.spark_partition_id())


def static_worker(k: Column | str, count: Column | int, workers: int, grain: int = 0) -> Column:
    """The worker of iteration ``k`` of ``count``: contiguous near-equal blocks, or chunk c of ``grain`` to worker c mod n."""
    k = F.col(k) if isinstance(k, str) else k
    if grain > 0:
        return F.pmod(F.floor(k / grain), F.lit(workers)).cast("int")
    count = F.lit(count) if isinstance(count, int) else count
    small, extra = F.floor(count / workers), F.pmod(count, F.lit(workers))
    edge = extra * (small + 1)
    return F.when(k < edge, F.floor(k / (small + 1))).otherwise(extra + F.floor((k - edge) / F.greatest(small, F.lit(1)))).cast("int")


def chunk_of(k: Column | str, grain: int) -> Column:
    return F.floor((F.col(k) if isinstance(k, str) else k) / grain).cast("long")


def partials(df: DataFrame, by: Column, **aggregates: Column) -> DataFrame:
    """A reduction's partial results, one row for each worker or chunk."""
    return df.groupBy(by.alias("part")).agg(*[a.alias(n) for n, a in aggregates.items()])


OPERATORS = {"+": F.sum, "*": F.product, "min": F.min, "max": F.max, "&": F.bit_and, "|": F.bit_or, "^": F.bit_xor}
_FOLD = {"+": lambda a, b: a + b, "*": lambda a, b: a * b, "min": F.least, "max": F.greatest, "&": lambda a, b: a.bitwiseAND(b), "|": lambda a, b: a.bitwiseOR(b), "^": lambda a, b: a.bitwiseXOR(b)}


def reduce_all(df: DataFrame, **reductions: tuple[str, str | Column, object]) -> DataFrame:
    """One row: for each name ``(operator, value, initial)`` the values folded onto the initial one.

    Every worker starts at the operator's identity and partial results are folded onto the initial value once, so the
    result does not depend on the number of workers. Without items it is the initial value.
    """
    out = []
    for name, (op, value, initial) in reductions.items():
        total = OPERATORS[op](F.expr(value) if isinstance(value, str) else value)
        out.append(F.when(total.isNull(), F.lit(initial)).otherwise(_FOLD[op](F.lit(initial), total)).alias(name))
    return df.agg(*out)


def ordered_fold(df: DataFrame, key: str | None, order: str, value: str, start: str, step, finish=lambda a: a, name: str = "result") -> DataFrame:
    """A fold whose steps do not commute, in the order of ``order`` within each key: for reducers that see one item at a time.

    ``step`` takes the accumulator and the next value as columns. A key's values are gathered, so keys must be small;
    without a key the whole input is one.
    """
    packed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda s: s["v"])
    grouped = df.groupBy(key) if key else df.groupBy()
    return grouped.agg(F.aggregate(packed, F.expr(start), step, finish).alias(name))


def fold_with(df: DataFrame, body: Callable[[tuple, pd.DataFrame], tuple], identity: tuple, final: Callable[[tuple, tuple], tuple], schema: str, fan_in: int = 64) -> DataFrame:
    """One row: an aggregate that a program defines. Every task starts at ``identity`` and folds its rows with ``body``, an
    Arrow batch at a time; ``final`` joins partial results, ``fan_in`` tasks' at a time, so none gets them all at once."""
    names = [c.split()[0] for c in schema.split(", ")]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = identity
        for b in batches:
            state = body(state, b)
        yield pd.DataFrame([state], columns=names)

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = identity
        for b in batches:
            for row in b.itertuples(index=False, name=None):
                state = final(state, row)
        yield pd.DataFrame([state], columns=names)

    out, parts = df.mapInPandas(partial, schema), df.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // fan_in)
        out = out.coalesce(parts).mapInPandas(join, schema)
    return out


def keyed_scan(df: DataFrame, key: str, order: str, columns: list[str], start: Callable[[], object], step: Callable[[object, tuple], object], schema: str) -> DataFrame:
    """(key, order, result): an ordered, stateful step over each key's items, for folds that do not commute.

    ``step(state, values)`` changes the state and gives the item's result. Keys are sorted on the JVM, which may spill, and
    streamed through: memory holds one state, however many items a key has.
    """
    rows = df.select(F.col(key).alias("key"), F.col(order).alias("ord"), *columns)
    result = f"{schema.split()[0]} {schema.split()[1]}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for b in batches:
            out = []
            for k, *values in b[["key", *columns]].itertuples(index=False, name=None):
                if state is None or k != now:
                    now, state = k, start()
                out.append(step(state, tuple(values)))
            yield pd.DataFrame({"key": b["key"], "ord": b["ord"], schema.split()[0]: out})

    kinds = dict(rows.dtypes)
    return rows.repartition("key").sortWithinPartitions("key", "ord").mapInPandas(run, f"key {kinds['key']}, ord {kinds['ord']}, {result}")


def last_writer(df: DataFrame, slot: Column | str, value: str, order: str) -> DataFrame:
    """(slot, value): of all writes to a slot the one that comes last in ``order``."""
    slot = F.expr(slot) if isinstance(slot, str) else slot
    return df.groupBy(slot.alias("slot")).agg(F.max_by(value, order).alias("value"))


def dot(left: DataFrame, right: DataFrame, index: str, a: str, b: str, initial: float | int = 0) -> DataFrame:
    """``initial`` plus the sum of products of two arrays held as (index, value) rows."""
    joined = left.select(index, F.col(a).alias("_a")).join(right.select(index, F.col(b).alias("_b")), index)
    return joined.agg((F.lit(initial) + F.coalesce(F.sum(F.col("_a") * F.col("_b")), F.lit(0))).alias("dot"))
