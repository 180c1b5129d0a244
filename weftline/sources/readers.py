"""Generators, text lines, delimited records and tables."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def generate(spark: SparkSession, start: int, more: Callable[[int], bool] | None, step: int, count: int | None = None, name: str = "i") -> DataFrame:
    """The stream ``start, start + step, ...``: ``count`` items, or as long as ``more`` holds of the next one.

    A condition is a Python predicate of the counter; where it is one is found by doubling and bisection on the driver,
    so a generator that a condition ends must end for good once it has ended.
    """
    if count is None:
        low, high = -1, 1
        while more(start + high * step):
            low, high = high, 2 * high
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if more(start + mid * step) else (low, mid)
        count = high if low >= 0 or more(start) else 0
    return spark.range(count).select((F.col("id") * step + start).alias(name), F.col("id").alias("seq"))


def text_lines(df: DataFrame, text: str, key: str, max_line: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carried columns, line, text_line): the non-empty lines of each text, numbered from 0 within it; with ``max_line``, no longer ones."""
    lines = df.select(F.col(key).alias("key"), *carry, F.posexplode(F.split(F.col(text), "\n")).alias("line", "text_line")).where(F.length("text_line") > 0)
    return lines.where(F.length("text_line") <= max_line) if max_line else lines


def text_file_lines(spark: SparkSession, path: str, max_line: int | None = None) -> DataFrame:
    """(line, text_line) of a text source. Lines are numbered in the order of the files' parts and of lines in a part.

    The number of lines in each partition is counted first, so that none has to wait for the one before.
    """
    lines = spark.read.text(path).withColumn("_id", F.monotonically_increasing_id())
    lines = lines.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1)).where(F.length("value") > 0)
    sizes = lines.groupBy("_part").agg(F.count("*").alias("_n"))
    begins = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_begin"))  # a row for each partition
    placed = lines.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy("_at")) - 1)
    out = placed.join(F.broadcast(begins), "_part").select((F.col("_begin") + F.col("_row")).alias("line"), F.col("value").alias("text_line"))
    return out.where(F.length("text_line") <= max_line) if max_line else out


def records(df: DataFrame, line: str, fields: Iterable[tuple[int, str, str]], least: int, separator: str = ",") -> DataFrame:
    """Typed records of delimited lines without quoting; lines of fewer than ``least`` fields are dropped.

    ``fields`` are (position, name, type); what is no number becomes 0, as is usual where parsing must not fail.
    """
    parts = F.split(F.col(line), separator.replace("|", r"\|"))
    full = df.withColumn("_parts", parts).where(F.size("_parts") >= least)
    return full.select(*[c for c in df.columns if c != line], *[_typed(F.get("_parts", F.lit(at)), kind).alias(name) for at, name, kind in fields])


def incomplete(df: DataFrame, line: str, least: int, separator: str = ",") -> DataFrame:
    """One row: how many lines :func:`records` drops."""
    return df.select(F.count_if(F.size(F.split(F.col(line), separator)) < least).alias("incomplete"))


def _typed(raw: Column, kind: str) -> Column:
    if kind == "string":
        return raw
    zero = F.lit(0).cast(kind)
    return F.coalesce(raw.try_cast(kind), F.regexp_extract(raw, r"^\s*([+-]?[0-9]+)", 1).try_cast(kind) if kind in ("int", "bigint") else F.regexp_extract(raw, r"^\s*([+-]?[0-9]*\.?[0-9]+)", 1).try_cast(kind), zero)


def replay(df: DataFrame, generations: int) -> DataFrame:
    """``df`` so many times over, with ``generation`` from 0: a bounded number of passes over one dataset."""
    return df.withColumn("generation", F.explode(F.sequence(F.lit(0), F.lit(generations - 1))))


def replay_for(df: DataFrame, sink: Callable[[DataFrame, int], None], seconds: float, per_second: float | None = None) -> tuple[int, int]:
    """(passes, items): ``sink(df, pass)`` for whole passes over ``df`` until ``seconds`` have gone by; at least one.

    With ``per_second`` a pass starts no sooner than that rate allows for what was sent before it.
    """
    size, began, passes = df.count(), time.monotonic(), 0
    while True:
        sink(df, passes)
        passes += 1
        if time.monotonic() - began >= seconds:
            return passes, passes * size
        if per_second:
            time.sleep(max(0.0, passes * size / per_second - (time.monotonic() - began)))


def invoke(spark: SparkSession, call: Callable[[int, int], tuple | None], schema: str, sources: int = 1, batch: int = 10_000) -> DataFrame:
    """What nodes without input give: each of ``sources`` tasks calls ``call(source, k)`` with k = 0, 1, ... until it gives None."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for source in b["id"].tolist():
                rows, k = [], 0
                while (row := call(source, k)) is not None:
                    rows.append(row)
                    k += 1
                    if len(rows) == batch:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return spark.range(0, sources, 1, sources).mapInPandas(run, schema)


def road_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments of road lines, prepared as Parquet (cell, road_id, file_order, ord, x1, y1, x2, y2)."""
    schema = T.StructType([T.StructField("cell", T.StringType()), T.StructField("road_id", T.LongType()), T.StructField("file_order", T.IntegerType()), T.StructField("ord", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("x1", "y1", "x2", "y2")]])
    return spark.read.schema(schema).parquet(path)


def count_sink(df: DataFrame, name: str = "items") -> DataFrame:
    """One row: how many items arrived."""
    return df.agg(F.count("*").alias(name))
