"""Operators on single items: map, filter, flat-map, early stop, selection and observation."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def map_items(df: DataFrame, **columns: Column | str) -> DataFrame:
    """One item for each item: new or replaced columns, given as expressions or SQL text."""
    return df.withColumns({k: F.expr(v) if isinstance(v, str) else v for k, v in columns.items()})


def project(df: DataFrame, *columns: Column | str) -> DataFrame:
    return df.select(*columns)


def filter_items(df: DataFrame, keep: Column | str) -> DataFrame:
    return df.where(keep)


def flat_map(df: DataFrame, items: Column, name: str = "item") -> DataFrame:
    """As many items as the array ``items`` has; an empty or null one drops the row."""
    return df.select("*", F.explode(items).alias(name))


def take_while(df: DataFrame, stop: Column | str, order: str, channel: str | None = None) -> DataFrame:
    """The items of each channel before its first one for which ``stop`` holds; that item and all later ones are dropped.

    The first stop is an aggregate by channel, so no channel is sorted or gathered.
    """
    stop = F.expr(stop) if isinstance(stop, str) else stop
    first = df.where(stop)
    if channel is None:
        return df.join(F.broadcast(first.agg(F.min(order).alias("_stop"))), F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).drop("_stop")
    first = first.groupBy(F.col(channel).alias("_channel")).agg(F.min(order).alias("_stop"))
    joined = df.join(first, F.col(channel).eqNullSafe(F.col("_channel")), "left")
    return joined.where(F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).drop("_channel", "_stop")


def select_node(on: str, alternatives: Mapping[object, Column], default: object) -> Column:
    """The result of the alternative that the item's command names; unknown commands take the ``default`` one."""
    out = None
    for command, result in alternatives.items():
        out = F.when(F.col(on) == F.lit(command), result) if out is None else out.when(F.col(on) == F.lit(command), result)
    return out.otherwise(alternatives[default])


def kernel_measures(df: DataFrame, on: str, alternatives: Mapping[object, Column], default: object) -> DataFrame:
    """(command, items): how many items each alternative gets; commands that none has count for the ``default`` one."""
    known = F.col(on).isin([k for k in alternatives])
    return df.groupBy(F.when(known, F.col(on)).otherwise(F.lit(default)).alias("command")).agg(F.count("*").alias("items"))


def with_callbacks(df: DataFrame, name: str, before: Callable[[DataFrame], list[Column]], node: Callable[[DataFrame], DataFrame], after: Callable[[DataFrame], list[Column]]) -> tuple[DataFrame, Observation, Observation]:
    """``node`` with metrics taken of its items as they go in and come out, in the run that an action starts."""
    seen, made = Observation(f"{name}-in"), Observation(f"{name}-out")
    out = node(df.observe(seen, *before(df)))
    return out.observe(made, *after(out)), seen, made


def in_box(latitude: str, longitude: str, speed: str, box: tuple[float, float, float, float]) -> Column:
    """Whether a position is inside (south, north, west, east), borders included, with a speed that is not negative."""
    south, north, west, east = box
    return F.col(latitude).between(south, north) & F.col(longitude).between(west, east) & (F.col(speed) >= 0)


#: Rows of one key and block that one task counts.
BLOCK_ROWS = 1 << 20


def order_block(df: DataFrame, order: str, rows: int = BLOCK_ROWS) -> Column:
    """The block of an item: a range of ``order``, as many ranges as give each about ``rows`` items of ``df``.

    Ranges are of equal width, so ``order`` should be a number that is spread evenly, as sequence numbers are.
    """
    lo, hi, n = df.agg(F.min(order), F.max(order), F.count(order)).first()
    if not n:
        return F.lit(0).cast("long")
    width = max(1, -(-(int(hi) - int(lo) + 1) // max(1, -(-n // rows))))
    return F.floor((F.col(order) - F.lit(lo)) / F.lit(width)).cast("long")


def even_blocks(df: DataFrame, order: str, weight: Column, size: int, least: int = 1 << 20) -> tuple[Column, int]:
    """The block of an item, numbered from 0, and how many blocks there are: ranges of ``order`` with about ``size`` of
    ``weight`` each, however ``order`` is spread. Items of one order share a block, and those without come last.

    A small input is cut for all cores, but not below ``least`` of ``weight``. The bounds are approximate percentiles,
    for which an item counts by its weight; they get to the driver.
    """
    heavy = F.coalesce(weight, F.lit(0))
    n, total = df.agg(F.count(order), F.coalesce(F.sum(heavy), F.lit(0))).first()
    blocks = min(n, max(-(-total // size), min(df.sparkSession.sparkContext.defaultParallelism, total // least)))
    if blocks < 2:
        return F.lit(0), 1
    copies = (F.floor(heavy / F.lit(max(1, total // (4 * n)))) + 1).cast("int")
    drawn = df.select(F.col(order).alias("_at"), F.explode(F.array_repeat(F.lit(0), copies)))
    ends = sorted(set(drawn.agg(F.percentile_approx("_at", [k / blocks for k in range(1, blocks)], 20 * blocks)).first()[0]))
    held = F.array(*map(F.lit, ends))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(ends).bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(held, at + step - 1) < F.col(order), at + step).otherwise(at))
    return F.when(F.col(order).isNull(), len(ends)).otherwise(below), len(ends) + 1


def running(df: DataFrame, key: Column | str | None, order: str, rows: int = BLOCK_ROWS, **values: Column) -> DataFrame:
    """``df`` with a running sum of each of ``values`` over the key's items in ``order``, this one included.

    A key, or without one the whole stream, is summed in two levels: blocks of ``order`` each for itself, and a block
    starts from the totals of those before it. So no task sees a whole key, and the keys' totals are combined before they
    are shuffled. ``order`` must tell a key's items apart.
    """
    names = list(values)
    cut = df.withColumns({"_key": F.lit(0) if key is None else F.col(key) if isinstance(key, str) else key, "_block": order_block(df, order, rows), **{f"_v_{n}": v for n, v in values.items()}})
    totals = cut.groupBy("_key", "_block").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    before = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    begins = totals.select("_key", "_block", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in names])
    begins = begins.select(F.col("_key").alias("_k"), F.col("_block").alias("_bl"), *[f"_b_{n}" for n in names])
    inside = Window.partitionBy("_key", "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.withColumns({f"_s_{n}": F.sum(f"_v_{n}").over(inside) for n in names})
    joined = summed.join(begins, F.col("_key").eqNullSafe(F.col("_k")) & F.col("_block").eqNullSafe(F.col("_bl")))
    return joined.select(*[c for c in df.columns if c not in names], *[(F.col(f"_b_{n}") + F.col(f"_s_{n}")).alias(n) for n in names])


def running_count(df: DataFrame, key: str, order: str, name: str = "id", rows: int = BLOCK_ROWS) -> DataFrame:
    """How often the key has occurred so far, this item included."""
    return running(df, key, order, rows, **{name: F.lit(1).cast("long")})


def epochs(df: DataFrame, is_write: Column, order: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``epoch``: the number of writes before the item, in ``order``. Reads of one epoch see the same state."""
    write = F.when(is_write, 1).otherwise(0).cast("long")
    out = running(df.withColumn("_write", write), None, order, rows, epoch=F.col("_write"))
    return out.withColumn("epoch", F.col("epoch") - F.col("_write")).drop("_write")
