"""SimHash near-duplicates by an inverted index over byte positions with count filtering.

Two 64-bit fingerprints at a distance of at most two bits share at least six of their eight positional bytes. Postings
of one (position, byte) each would be 2,048 lists whose pairs grow with the square of the input. A posting here names six
positions and their bytes instead (28 choices of six positions), so that pairs below the guaranteed minimum never meet.
Of the pairs that meet in a list the shared positional bytes are tallied, those that reach the minimum are retained, and
they alone are verified bit by bit. Members of a list differ in two bytes only, so in a list of thousands the pairs to tally
are looked up in a table of 65,536 places, which never makes all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import arrow_map, join_hot, partitions, read_table, stored, texts

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: The eight bits of every byte value, lowest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: Pairs of byte positions that a posting leaves out.
_FREE = list(combinations(range(8), 2))
_SMALL = 48
_FP = "_fingerprint_of_row"
_CHUNK = 1 << 18


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of UTF-8 bytes: bit by bit the majority over the hashes of all word shingles.

    A-Z are lower-cased and words split at ASCII white space; a text of fewer words is one shingle, one of none is 0.
    """
    words = text.lower().split()  # on bytes both touch ASCII only
    if not words:
        return 0
    count = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, _CHUNK):  # long texts in pieces of bounded size
        part = words[at : at + _CHUNK + shingle - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64)
        spots = hashes.view(np.uint8).reshape(-1, 8).astype(np.int64) + np.arange(0, 2048, 256)
        ones += (np.bincount(spots.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return sum(1 << int(b) for b in np.flatnonzero(2 * ones > count))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id long, fp long) for each row; ``fp`` is the fingerprint as a signed long. Null text is empty: 0."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter((fingerprint(t, shingle) for t in texts(batch.column(1))), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return arrow_map(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, "doc_id long, fp long")


def shared_bytes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The tally of each pair: at how many of the eight positions both fingerprints have the same byte."""
    return ((x ^ y)[..., None].view(np.uint8) == 0).sum(-1)


def _linked(x: np.ndarray, y: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs are linked: their tally reaches the minimum that ``max_bits`` guarantee, and their bits verify it."""
    out = shared_bytes(x, y) >= 8 - max_bits
    out[out] = np.bitwise_count(x[out] ^ y[out]) <= max_bits
    return out


def _forest(fps: np.ndarray, free: tuple[int, int], max_bits: int) -> np.ndarray:
    """Pairs that connect whatever ``max_bits`` links among fingerprints equal but for two bytes; at most one a member."""
    n = len(fps)
    if n <= _SMALL:
        near = _linked(*np.broadcast_arrays(fps[:, None], fps[None, :]), max_bits)
        a, b = np.nonzero(np.triu(near, 1))
        if len(a) < n:
            return np.stack([fps[a], fps[b]], 1)
        label = np.arange(n)
        while True:
            low = np.where(near, label[None, :], n).min(1)
            if (low == label).all():
                break
            label = low
        return np.stack([fps, fps[label]], 1)[label != np.arange(n)]
    value = ((fps >> np.uint64(8 * free[0])) & np.uint64(255)) | (((fps >> np.uint64(8 * free[1])) & np.uint64(255)) << np.uint64(8))
    value = value.astype(np.int64)
    member = np.full(1 << 16, -1, np.int64)
    member[value] = np.arange(n)
    pairs = []
    for m in (sum(1 << b for b in bits) for k in range(1, max_bits + 1) for bits in combinations(range(16), k)):
        other = member[value ^ m]
        mine = np.flatnonzero(other >= 0)
        mine = mine[_linked(fps[mine], fps[other[mine]], max_bits)]
        pairs.append((mine, other[mine]))
    label, old = np.arange(n), None
    while old is None or (label != old).any():
        old = label.copy()
        for mine, other in pairs:
            np.minimum.at(label, mine, label[other])
        label = label[label]
    return np.stack([fps, fps[label]], 1)[label != np.arange(n)]


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): pairs of different fingerprints that connect exactly what links of ``max_bits`` (at most two) bits connect.

    Each fingerprint goes to its 28 postings. Lists are sorted on the JVM, where they may spill, and streamed through; a
    list has at most 65,536 members, as its two free bytes tell them apart.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("lists that leave two bytes free serve links of at most two bits")
    postings = [F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(~((255 << 8 * a) | (255 << 8 * b))))).alias("rest")) for k, (a, b) in enumerate(_FREE)]
    rows = distinct.select("fp", F.explode(F.array(*postings)).alias("p")).select(F.col("p.k").alias("k"), F.col("p.rest").alias("rest"), "fp")
    lists = rows.repartition(partitions(distinct.sparkSession), "k", "rest").sortWithinPartitions("k", "rest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(x: np.ndarray) -> list[np.ndarray]:
            ends = np.flatnonzero((np.diff(x[:, 0]) != 0) | (np.diff(x[:, 1]) != 0)) + 1
            begins = np.concatenate([[0], ends])
            sizes = np.diff(np.concatenate([begins, [len(x)]]))
            out = []
            for at, n in zip(begins[sizes > 1], sizes[sizes > 1], strict=True):
                out.append(_forest(x[at : at + n, 2].view(np.uint64), _FREE[int(x[at, 0])], max_bits))
            return out

        def edges(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            pairs = [p for p in found if len(p)]
            if pairs:
                both = np.concatenate(pairs).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)
            if not len(x):
                continue
            x = np.concatenate([*held, x])
            changed = np.flatnonzero((np.diff(x[:, 0]) != 0) | (np.diff(x[:, 1]) != 0))
            cut = changed[-1] + 1 if len(changed) else 0  # the last list may go on in the next batch
            held = [x[cut:].copy()]
            if cut:
                yield from edges(flush(x[:cut]))
        if held:
            yield from edges(flush(held[0]))

    found = lists.mapInArrow(run, "a long, b long")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) with the smallest node it can reach, by alternating stars.

    A round joins each node's neighbours to its smallest one (large star), then hangs them below it (small star). The
    number of rounds grows with the logarithm of the longest chain; each ends in a table in the shared scratch folder.
    """
    def summary(df: DataFrame):
        return df.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = stored(edges.where("a <> b"), "edges")
    seen = summary(edges)
    for _ in range(most_rounds):
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct()
        edges = stored(small, "edges")
        was, seen = seen, summary(edges)
        if was == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError("the components are not done after the last round")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for each row; ``component_id`` is the smallest doc_id reachable over links.

    Rows with equal fingerprints, all empty texts included, are linked. A null doc_id is never the smallest; a component
    of null ids only has a null component_id. Repeated rows each get a row. Without rows there are none.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "distinct")
    roots = components(links(distinct.select("fp"), max_bits))
    known = stored(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "known")
    smallest = stored(known.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members")), "smallest")
    by_fp = stored(join_hot(known, smallest, "root", "members").select("fp", "n", "component_id"), "by-fingerprint")
    return join_hot(rows, by_fp, "fp", "n").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """One row of ``docs`` for each component, the one of the smallest doc_id, with all columns.

    Of repeated rows of one doc_id one stays. Where a component has null ids only, one row for each fingerprint stays.
    """
    found = near_duplicates(docs, **params)
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.count("*").alias("_n")).select(F.col("doc_id").alias("_keep"))
    named = docs.join(keep, F.col("doc_id").cast("long") == F.col("_keep"), "left_semi").dropDuplicates(["doc_id"])
    nameless = docs.where("doc_id IS NULL")
    if nameless.isEmpty():
        return named
    lone = found.where("doc_id IS NULL AND component_id IS NULL").select(F.col("fp").alias(_FP)).distinct()
    return named.unionByName(_with_fp(nameless).join(lone, _FP, "left_semi").dropDuplicates([_FP]).drop(_FP))


def _with_fp(docs: DataFrame) -> DataFrame:
    """``docs`` with the fingerprint in the column _FP, all other columns carried along."""
    names = docs.columns
    packed = docs.select(F.col("text").cast("string").alias("t"), F.struct(*names).alias("r"))
    schema = packed.select("r").schema.add(_FP, "long")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter((fingerprint(t) for t in texts(batch.column(0))), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(fps.view(np.int64))], ["r", _FP])

    return arrow_map(packed, run, schema).select("r.*", _FP)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
