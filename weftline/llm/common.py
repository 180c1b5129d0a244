"""What the operators of this subpackage share: scratch tables, small column helpers and Arrow plumbing."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are what stands between these characters.
WORD_GAP = r"[\x20\x09-\x0D]+"
ONE_GAP = r"[\x20\x09-\x0D]"

_roots: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once a row however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def scratch_root(spark: SparkSession) -> str:
    """A folder of this application under ``spark.checkpoint.dir``, which driver and executors share.

    Only on one machine (``local`` masters, as in tests) a temporary folder takes its place where that setting is missing.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='weftline-')}"
        _roots[app] = f"{base.rstrip('/')}/weftline-{app}"
        atexit.register(_drop, spark, _roots[app])
    return _roots[app]


def _drop(spark: SparkSession, root: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone by now
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet into the shared scratch folder and read back: its lineage ends there."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes ``stored`` tables that nothing reads any more, so that a long query holds few at once."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark deletes the shuffle files of each query when it ends, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def join_hot(rows: DataFrame, side: DataFrame, key: str, count: str, most: int = 10_000) -> DataFrame:
    """``rows`` joined with ``side``, which has one row for each value of ``key`` and, in ``count``, how many rows have it.

    Keys that hold more than one in ``most`` of all rows are ``most`` at most, so they are broadcast and their rows stay
    where they are; the rows of all others are shuffled. Keys are not null. Both tables are stored ones: they are read twice.
    """
    total = side.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * most > total
    few = F.broadcast(side.where(hot).select(F.col(key).alias("_hot_key")))
    met = rows.join(F.broadcast(side.where(hot)), key)
    rest = rows.join(few, F.col(key) == F.col("_hot_key"), "left_anti").join(side.where(~hot), key)
    return met.unionByName(rest)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """Each value's UTF-8 bytes without a detour over str; null becomes empty."""
    for x in column.cast(pa.binary()):
        yield x.as_py() or b""


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``fn`` over each Arrow batch of ``df``; batches for which it gives None vanish."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)
