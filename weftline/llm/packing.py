"""Sum-of-squares packing of documents into token sequences.

A document's ids and an end id are cut into pieces of at most the sequence length. Each piece goes to the open sequence
(or a new one) after which the sum over residual gaps of the squared number of open sequences with that gap is smallest.
The rule needs only the number of open sequences at each gap, so memory does not grow with what is packed. Pieces are
packed in chunks of bounded size, in mixed order and longest first, of which the better is taken; sequences that a chunk leaves with a large gap are packed again together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import arrow_map, read_table, stored
from weftline.llm.tokens import default_path, encoder, slices

SEQUENCE = 4096
END_ID = 1
#: Pieces that one task packs.
CHUNK = 60_000
#: Sequences with more free tokens than this are packed again, as long as there is more than one chunk of them.
LARGE_GAP = SEQUENCE // 32
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long, gap long"


def pieces(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """The pieces of every row of ``docs``. A null text is empty, so it has the end id alone; a null doc_id stays null."""
    path = path or default_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], [], []]
        names, text = batch.column(0).to_pylist(), batch.column(1)
        for begin, end in slices(text):
            ids, n = encoder(path).encode(text.slice(begin, end - begin))
            flat, at = ids.astype("<u4").tobytes(), 0
            for doc, count in zip(names[begin:end], n.tolist(), strict=True):
                raw = flat[4 * at : 4 * (at + count)] + end_id.to_bytes(4, "little")
                at += count
                for k, start in enumerate(range(0, count + 1, sequence)):
                    part = raw[4 * start : 4 * (start + sequence)]
                    for c, v in zip(cols, (doc, k, start, len(part) // 4, zlib.crc32(part)), strict=True):
                        c.append(v)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item in the order given, and the gap that each bin is left with.

    With ``n[g]`` open bins of gap ``g``, an item of size ``s`` in a bin of gap ``g`` changes the sum of squares by
    ``2 (n[g - s] - n[g]) + 2``, by ``1 - 2 n[s]`` if it fills the bin, and a new bin by ``2 n[capacity - s] + 1``. The
    smallest change wins; ties go to the smallest gap, and to an open bin before a new one.
    """
    n = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, gaps = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    none = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        gap = -1
        if s < capacity:
            have = n[s:capacity]
            cost = np.where(have > 0, 2 * (n[: capacity - s] - have) + 2, none)
            if have[0] > 0:
                cost[0] = 1 - 2 * have[0]
            at = int(cost.argmin())
            if cost[at] < none and cost[at] <= 2 * n[capacity - s] + 1:
                gap = at + s
        if gap < 0:
            b, gap = len(gaps), capacity
            gaps.append(capacity)
        else:
            b = open_bins[gap].pop()
            n[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        gaps[b] = left = gap - s
        if left:
            n[left] += 1
            open_bins[left].append(b)
    return bins, offsets, np.array(gaps, np.int64)


def _packed(table: pa.Table, base: int, sequence: int) -> pa.RecordBatch:
    length = table.column("length").to_numpy()
    mixed = np.argsort(table.column("ids_crc32").to_numpy(), kind="stable")
    tries = [(order, *sum_of_squares(length[order], sequence)) for order in (mixed, mixed[np.argsort(-length[mixed], kind="stable")])]
    order, bins, offsets, gaps = min(tries, key=lambda t: len(t[3]))
    table = table.take(pa.array(order))
    cols = [table.column(c).combine_chunks() for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
    return pa.RecordBatch.from_arrays([*cols, pa.array(base + bins), pa.array(offsets), pa.array(gaps[bins])], [f.split()[0] for f in PACKED.split(", ")])


def pack(found: DataFrame, sequence: int = SEQUENCE, chunk: int = CHUNK) -> DataFrame:
    """``found`` (columns of PIECES, stored) with sequence_id and offset.

    Rows are dealt to chunks evenly whatever their keys are, so no key makes a large chunk; equal rows are packed each on
    its own. No rows give none.
    """

    def one_round(rows: DataFrame, count: int, level: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [b for b in batches if b.num_rows]
            if got:
                yield _packed(pa.Table.from_batches(got), level << 60 | TaskContext.get().partitionId() << 32, sequence)

        return stored(rows.repartition(count).mapInArrow(run, PACKED), "packed")

    names = [f.split()[0] for f in PIECES.split(", ")]
    count = -(-found.count() // chunk)
    if not count:
        return found.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = one_round(found, count, 0)
    if count > 1:
        loose = out.where(F.col("gap") > LARGE_GAP)
        again = -(-loose.count() // chunk)
        if again:
            out = out.where(F.col("gap") <= LARGE_GAP).unionByName(one_round(loose.select(*names), again, 1))
    return out.drop("gap")


def pack_documents(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each row of ``docs``."""
    return pack(stored(pieces(docs, path, sequence), "pieces"), sequence)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
