"""Sources, state and sinks of graphs that run as Structured Streaming queries, and programs that feed a graph themselves."""

from __future__ import annotations

import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.operators.iterate import cut
from weftline.operators.iterate import shared_folder as checkpoint_folder
from weftline.plans.graph import Node, Pipeline, TopologyError, validate
from weftline.plans.lower import run

KEY_COUNT = "key string, seen long"


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share: under the session's checkpoint folder, where it has one."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """A table's Parquet files as a stream, a bounded number at a time."""
    path = f"{sf_dir}/{name}.parquet"
    known = spark.read.parquet(path)
    reader = spark.readStream.schema(known.schema).option("maxFilesPerTrigger", files_per_trigger)
    if any(f.rstrip("/").endswith(f"{name}.parquet") for f in known.inputFiles()[:1]):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(path)


def check_streamable(node: Node) -> None:
    """Loops cannot run as a stream: they iterate within a batch."""
    validate(node)
    if isinstance(node, Pipeline):
        if node.feedback:
            raise TopologyError("a stream has no cycles; run the loop in a batch, or within foreachBatch")
        for s in node.stages:
            check_streamable(s)


def run_stream(node: Node, source: DataFrame) -> DataFrame:
    check_streamable(node)
    return run(node, source)


def drain(df: DataFrame, mode: str = "append", label: str = "stream") -> DataFrame:
    """Run a streaming DataFrame over all that its source has, then stop: the rows it has written.

    In ``append`` mode all batches' rows; in ``complete`` mode the last batch's; in ``update`` mode all updates, with
    their ``batch``. Rows go to Parquet in the shared folder, never through the driver.
    """
    spark = df.sparkSession
    out, marks = shared_folder(spark, label), shared_folder(spark, f"{label}-marks")
    if mode == "append":
        query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(df.schema).parquet(out)

    def write(batch: DataFrame, k: int) -> None:
        (batch if mode == "complete" else batch.withColumn("batch", F.lit(k).cast("long"))).write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/{k}")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    schema = df.schema if mode == "complete" else T.StructType([*df.schema, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).parquet(out if mode == "complete" else f"{out}/*")


def keyed_fold(df: DataFrame, key: str, start: tuple, step: Callable[[tuple, tuple], tuple], columns: list[str], state: str, output: str) -> DataFrame:
    """Per-key state over a stream: ``step`` folds a row's ``columns`` into the key's state, which leaves after each batch.

    ``output`` is the schema of (key, *state). State is kept in the query's state store and survives a restart.
    """

    def fold(k: tuple, parts: Iterator[pd.DataFrame], store: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(store.get) if store.exists else start
        for part in parts:
            for row in part[columns].itertuples(index=False, name=None):
                now = step(now, row)
        store.update(now)
        yield pd.DataFrame([(*k, *now)], columns=[c.split()[0] for c in output.split(", ")])

    return df.groupBy(key).applyInPandasWithState(fold, output, state, "update", GroupStateTimeout.NoTimeout)


def windowed(df: DataFrame, ts: str, late: str, width: str, slide: str | None, keys: list[str], **aggregates: Column) -> DataFrame:
    """Event-time windows with a watermark: (window_start, keys, aggregates). Rows later than ``late`` are dropped."""
    at = df.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    grouped = at.groupBy(F.window("_ts", width, slide) if slide else F.window("_ts", width), *keys)
    return grouped.agg(*[a.alias(n) for n, a in aggregates.items()]).select(F.col("window.start").alias("window_start"), *keys, *aggregates)


def sessions(df: DataFrame, ts: str, late: str, gap: str, keys: list[str], **aggregates: Column) -> DataFrame:
    """Event-time sessions, which ``gap`` without an item ends: (session_start, session_end, keys, aggregates)."""
    at = df.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    grouped = at.groupBy(F.session_window("_ts", gap), *keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    return grouped.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, *aggregates)


def run_loops(node: Node, source: DataFrame, label: str = "loops") -> DataFrame:
    """A graph with feedback over a stream: each batch of items goes round until none is left, then the next one comes.

    A stream itself has no cycles, so the loop runs inside the batch. The rows of all batches are written to the shared
    folder; a batch that is run again after a failure replaces what it wrote.
    """
    out, marks = shared_folder(source.sparkSession, label), shared_folder(source.sparkSession, f"{label}-marks")
    schemas: list[T.StructType] = []

    def write(batch: DataFrame, k: int) -> None:
        made = run(node, batch)
        schemas.append(made.schema)
        made.write.mode("overwrite").parquet(f"{out}/{k}")

    source.writeStream.option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    if not schemas:
        return run(node, source.sparkSession.createDataFrame([], source.schema))
    return source.sparkSession.read.schema(schemas[0]).parquet(f"{out}/*")


def arrivals(df: DataFrame, order: str, batches: int, label: str = "arrivals") -> DataFrame:
    """``df`` as a stream of ``batches`` batches in the order of ``order``, as a log that comes in: a file each, one at a time."""
    spark = df.sparkSession
    folder = shared_folder(spark, label)
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    width = max(1, -(-(int(hi or 0) - int(lo or 0) + 1) // batches))
    for k in range(batches):  # one after another, as files are read by the time they were written
        part = df.where((F.col(order) >= (lo or 0) + k * width) & (F.col(order) < (lo or 0) + (k + 1) * width))
        part.coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


class Frozen:
    """A graph that is run, then rests until it is run again on more input, with as many workers as that time asks for.

    Results are the same for any number of workers.
    """

    def __init__(self, node: Node) -> None:
        validate(node)
        self.node, self.runs = node, 0

    def run_then_freeze(self, source: DataFrame, workers: int | None = None) -> DataFrame:
        """The results over ``source``, computed when this returns."""
        spark, name = source.sparkSession, "spark.sql.shuffle.partitions"
        old = spark.conf.get(name)
        try:
            if workers:
                spark.conf.set(name, str(workers))
            self.runs += 1
            return cut(run(self.node, source))
        finally:
            spark.conf.set(name, old)


class Accelerator:
    """A graph that a program feeds item by item, and whose results it loads as they come.

    Items are gathered to batches of ``batch_items``; a full batch runs, and ``flush`` runs what there is. After
    ``end`` no more items are taken, and loading ends when the results do.
    """

    def __init__(self, spark: SparkSession, node: Node, schema: str | T.StructType, batch_items: int = 10_000) -> None:
        check_streamable(node)
        self.spark, self.node, self.schema, self.batch_items = spark, node, schema, batch_items
        self.waiting: list[tuple] = []
        self.results: deque[Iterator[Row]] = deque()
        self.ended = False

    def offload(self, *items: tuple) -> None:
        if self.ended:
            raise RuntimeError("the stream has ended")
        self.waiting.extend(items)
        if len(self.waiting) >= self.batch_items:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            rows, self.waiting = self.waiting, []
            self.results.append(run(self.node, self.spark.createDataFrame(rows, self.schema)).toLocalIterator())

    def end(self) -> None:
        self.flush()
        self.ended = True

    def load_result_nb(self) -> Row | None:
        """The next result that is there, or None."""
        while self.results:
            row = next(self.results[0], None)
            if row is not None:
                return row
            self.results.popleft()
        return None

    def load_result(self) -> Row | None:
        """The next result; None once the stream has ended and all are loaded. What waits is run first."""
        row = self.load_result_nb()
        if row is None and self.waiting:
            self.flush()
            row = self.load_result_nb()
        return row
