"""Token counts of documents in flat, unindexed token files, by scanning for the end-of-document id.

A file is read as blocks. Each block is searched on its own, vectorised, and yields the places of its separators. A
document may begin in one block and end many blocks later: a prefix scan over the blocks' totals tells each block how many
tokens and documents came before it and where the document that is open at its start began.

Files are read by Spark's own reader, so they lie in any store that Spark reads and are split by byte range, whatever
their size. That reader cuts at line feeds, whose places mean nothing here: its pieces are joined again, a split's bytes are
searched without knowing whether it begins inside a token, and once the bytes before each split are added up, matches
that do not begin with a token are dropped and those across the edges of splits are added.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import let, read_table, scratch_root, stored
from weftline.llm.tokens import default_path, encoder, slices

#: An id behind the vocabulary's 49,408; ids and separator fit 16 bits. In big-endian files its two bytes are the UTF-8 form
#: of one character, so Spark's text writer, with that character between its rows, writes flat token files.
END_OF_DOCUMENT = 49_792
WIDTH = ">u2"
BLOCK_TOKENS = 1 << 18
#: Blocks that one step of the prefix scan adds up; a file's groups are scanned after its blocks' groups are.
GROUP = 1024
BLOCKS = "file string, block long, payload binary"


def write_blocks(docs: DataFrame, path: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One flat token file for each partition of ``docs``, as (file, block, payload) with blocks in order from 0.

    Payloads are little-endian unsigned 16-bit ids; every text, null ones as empty, ends with END_OF_DOCUMENT. Files are
    named after tasks, so they are stored before use: two reads see the same files.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, block, open_part = f"tokens-{TaskContext.get().partitionId():06d}.bin", 0, np.empty(0, np.uint16)

        def out(x: np.ndarray, k: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64()), pa.array([x.astype("<u2").tobytes()], pa.binary())], ["file", "block", "payload"])

        for batch in batches:
            for begin, end in slices(batch.column(0)):
                ids, n = encoder(path).encode(batch.column(0).slice(begin, end - begin))
                open_part = np.concatenate([open_part, np.insert(ids, np.cumsum(n), END_OF_DOCUMENT).astype(np.uint16)])
                while len(open_part) >= block_tokens:
                    yield out(open_part[:block_tokens], block)
                    open_part, block = open_part[block_tokens:], block + 1
        if len(open_part):
            yield out(open_part, block)

    return docs.select(F.col("text").cast("string")).mapInArrow(run, BLOCKS)


def write_files(docs: DataFrame, path: str, vocabulary: str | None = None) -> DataFrame:
    """(part, doc_no, doc_id) of the flat token files that are written to the folder ``path``, one for each partition of ``docs``.

    A file holds the big-endian 16-bit ids of its texts, each text, null ones as empty, followed by END_OF_DOCUMENT, and
    nothing else; ``part`` is the number in its name. Files do not name documents: what is returned does, by a second
    scan in the same order, so ``docs`` must be a scan of files. Should that scan be cut otherwise, counts differ and it fails.
    """
    vocabulary = vocabulary or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column(0)):
                ids, n = encoder(vocabulary).encode(batch.column(0).slice(begin, end - begin))
                raw, at = memoryview(ids.astype(WIDTH).tobytes()), np.append(0, 2 * np.cumsum(n)).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([bytes(raw[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.binary())], ["value"])

    tokens = docs.select(F.col("text").cast("string")).mapInArrow(run, "value binary")
    tokens.select(F.col("value").cast("string").alias("value")).write.option("lineSep", END_OF_DOCUMENT.to_bytes(2, "big").decode()).text(path)
    place = F.monotonically_increasing_id()
    return stored(docs.select(F.shiftright(place, 33).cast("int").alias("part"), place.bitwiseAND((1 << 33) - 1).alias("doc_no"), F.col("doc_id").cast("long").alias("doc_id")), "document-places")


def scan_files(spark: SparkSession, path: str, end_id: int = END_OF_DOCUMENT, width: str = WIDTH, chunk: int = 1 << 20) -> DataFrame:
    """(file, block, n, ends, tokens): separators by token place in the file, for each part of a split that was searched.

    ``file`` is a path, ``block`` orders a file's parts, ``n`` is 0, as places count from the file's start, and ``tokens`` is
    the file's number of tokens. Bytes that are no whole token at the end of a file are ignored.
    """
    size = np.dtype(width).itemsize
    needle = np.frombuffer(np.array([end_id], width).tobytes(), np.uint8)
    kept = size - 1

    def search(data: np.ndarray) -> np.ndarray:
        if len(data) < size:
            return np.empty(0, np.int64)
        hit = data[: len(data) - kept] == needle[0]
        for k in range(1, size):
            hit &= data[k : len(data) - kept + k] == needle[k]
        return np.flatnonzero(hit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, at, seq, tail = None, [], 0, 0, np.empty(0, np.uint8)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, at, seq, tail
            if held:
                data = np.concatenate([tail, *held])
                n = len(data) - len(tail)
                hits = search(data) + (at - len(tail))
                columns = [pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([seq], pa.int64()), pa.array([n], pa.int64()), pa.array([hits], pa.list_(pa.int64()))]
                edges = [pa.array([data[len(tail) : len(tail) + kept].tobytes() if seq == 0 else None], pa.binary()), pa.array([data[len(data) - kept :].tobytes() if kept else b""], pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *edges], ["file", "split", "seq", "n", "hits", "head", "tail"])
                tail, at, seq, held = data[len(data) - kept :] if kept else tail, at + n, seq + 1, []

        for batch in batches:
            if not batch.num_rows:
                continue
            value = batch.column(0).cast(pa.large_binary())
            offsets = np.frombuffer(value.buffers()[1], np.int64)[value.offset : value.offset + len(value) + 1]
            data = np.frombuffer(value.buffers()[2] or b"", np.uint8)
            key = np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if now != tuple(key[a].tolist()):
                    yield from flush()
                    now, at, seq, tail = tuple(key[a].tolist()), 0, 0, np.empty(0, np.uint8)
                step = a
                while step < b:  # rows of a batch may be long: some MB at a time
                    to = min(b, max(step + 1, int(np.searchsorted(offsets, offsets[step] + chunk))))
                    held.append(np.insert(data[offsets[step] : offsets[to]], offsets[step + 1 : to + 1] - offsets[step], 10))
                    step = to
                    if sum(map(len, held)) >= chunk:
                        yield from flush()
        yield from flush()

    lines = spark.read.option("lineSep", "\n").text(path)
    path_of = F.col("_metadata.file_path")
    found = lines.select(F.col("value").cast("binary"), F.xxhash64(path_of).alias("file"), F.col("_metadata.file_block_start").alias("split")).mapInArrow(run, "file long, split long, seq long, n long, hits array<long>, head binary, tail binary")
    found = stored(found, "scanned")
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64(path_of).alias("file"), path_of.alias("path"), F.col("length"))
    splits = found.groupBy("file", "split").agg(F.sum("n").alias("n"), F.max("head").alias("head"), F.max_by("tail", "seq").alias("tail"))

    def place(t: pd.DataFrame) -> pd.DataFrame:
        """Where each split of one file begins, and the separators across its front edge; a row for each split."""
        t = t.sort_values("split")
        # a mark at the very beginning that the reader takes for no text is not given, and a last line feed may be made up
        lost = 3 if int(t["n"].sum()) + 3 <= int(t["length"].iloc[0]) + 1 else 0
        out, begin, before = [], lost, b"\xef\xbb\xbf"[-kept:] if lost and kept else b""
        for row in t.itertuples(index=False):
            edge = before + row.head
            hits = search(np.frombuffer(edge, np.uint8)) + (begin - len(before))
            # what lies in the split as a whole is found there
            out.append((row.file, row.split, begin, [int(h) for h in hits if h < begin and h + size <= begin + row.n], row.path, row.length))
            begin += row.n
            before = (before + row.tail)[-kept:] if kept else b""
        return pd.DataFrame(out, columns=["file", "split", "begin", "edge", "path", "length"])

    # one row for each split of a file: some eight thousand for a file of a TB
    placed = splits.join(files, "file").groupBy("file").applyInPandas(place, "file long, split long, begin long, edge array<long>, path string, length long")
    hits = F.concat(F.transform("hits", lambda h: h + F.col("begin")), F.when(F.col("seq") == 0, F.col("edge")).otherwise(F.array().cast("array<long>")))
    whole = F.filter(hits, lambda h: (h % size == 0) & (h + size <= F.col("length")))
    ends = F.array_sort(F.transform(whole, lambda h: (h / size).cast("long")))
    order = F.dense_rank().over(Window.partitionBy("file").orderBy("split")) - 1
    numbered = found.join(placed.withColumn("_split", order.cast("long")), ["file", "split"])
    return numbered.select(F.col("path").alias("file"), (F.col("_split") * GROUP + F.col("seq")).alias("block"), F.lit(0).cast("long").alias("n"), ends.alias("ends"), F.floor(F.col("length") / size).alias("tokens"))


def count_files(spark: SparkSession, path: str, end_id: int = END_OF_DOCUMENT, width: str = WIDTH, chunk: int = 1 << 20) -> DataFrame:
    """(file, doc_no, start, n_tokens, closed) of the flat token files at ``path``, as :func:`count_tokens` gives them."""
    found = scan_files(spark, path, end_id, width, chunk)
    return _documents(stored(stitch(found.drop("tokens")).join(found.select("file", "block", "tokens"), ["file", "block"]), "separators"))


def find_separators(blocks: DataFrame, end_id: int = END_OF_DOCUMENT, width: str = "<u2") -> DataFrame:
    """(file, block, n, ends): a block's number of tokens and the places of its separators, from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ends = [], []
            for p in batch.column(2):
                ids = np.frombuffer(p.as_buffer(), width) if p.is_valid else np.empty(0, width)
                n.append(len(ids))
                ends.append(np.flatnonzero(ids == end_id))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], ["file", "block", "n", "ends"])

    return blocks.select("file", "block", "payload").mapInArrow(run, "file string, block long, n long, ends array<long>")


def stitch(found: DataFrame, group: int = GROUP) -> DataFrame:
    """``found`` with what the blocks before hold: tokens, documents, and the end of the last separator (token places in the file).

    The scan has two steps, so that a file with a third of all blocks is not scanned in one task: inside groups of blocks,
    and over the groups' totals.
    """
    found = found.withColumn("_group", F.floor(F.col("block") / group))
    found = found.withColumn("_seps", F.size("ends").cast("long")).withColumn("_last", F.when(F.size("ends") > 0, F.element_at("ends", -1) + 1))
    inside = Window.partitionBy("file", "_group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("_tokens", F.coalesce(F.sum("n").over(inside), F.lit(0))).withColumn("_docs", F.coalesce(F.sum("_seps").over(inside), F.lit(0)))
    placed = placed.withColumn("_own", F.col("_tokens") + F.col("_last")).withColumn("_since", F.max("_own").over(inside))
    totals = placed.groupBy("file", "_group").agg(F.sum("n").alias("g_n"), F.sum("_seps").alias("g_seps"), F.max("_own").alias("g_last"))
    over = Window.partitionBy("file").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("g_tokens", F.coalesce(F.sum("g_n").over(over), F.lit(0))).withColumn("g_docs", F.coalesce(F.sum("g_seps").over(over), F.lit(0)))
    totals = totals.withColumn("g_since", F.max(F.col("g_tokens") + F.col("g_last")).over(over)).select("file", "_group", "g_tokens", "g_docs", "g_since")
    return placed.join(totals, ["file", "_group"]).select(
        "file", "block", "n", "ends",
        (F.col("g_tokens") + F.col("_tokens")).alias("tokens_before"),
        (F.col("g_docs") + F.col("_docs")).alias("docs_before"),
        F.coalesce(F.col("g_tokens") + F.col("_since"), F.col("g_since"), F.lit(0)).alias("open_since"),
    )


def count_tokens(blocks: DataFrame, end_id: int = END_OF_DOCUMENT, width: str = "<u2", group: int = GROUP) -> DataFrame:
    """(file, doc_no, start, n_tokens, closed): every document of every file, separators not counted.

    Two separators in a row bound an empty document. Tokens after a file's last separator are a document that is not
    ``closed``. A null payload is an empty block. Blocks must have distinct numbers within a file; gaps do not matter.
    """
    return _documents(stored(stitch(find_separators(blocks, end_id, width), group), "separators"))


def _documents(at: DataFrame) -> DataFrame:
    """The documents that stitched separators bound. ``tokens``, where there is such a column, is the file's number of tokens."""
    ends = F.transform("ends", lambda e: e + F.col("tokens_before"))
    # each document brings its own start, so that no row of the explosion carries the block's other documents
    spans = let(ends, lambda x: F.transform(x, lambda e, k: F.struct(F.when(k > 0, F.get(x, k - 1) + 1).otherwise(F.col("open_since")).alias("start"), e.alias("end"))))
    docs = at.select("file", "docs_before", F.posexplode_outer(spans).alias("k", "span")).where("span IS NOT NULL")
    closed = docs.select("file", (F.col("docs_before") + F.col("k")).alias("doc_no"), F.col("span.start").alias("start"), (F.col("span.end") - F.col("span.start")).alias("n_tokens"), F.lit(True).alias("closed"))
    last_end = F.coalesce(F.element_at(F.col("_e"), -1) + 1 + F.col("tokens_before"), F.col("open_since"))
    tail = at.withColumn("_e", F.when(F.size("ends") > 0, F.col("ends")))
    length = F.col("tokens") if "tokens" in at.columns else F.col("tokens_before") + F.col("n")
    tail = tail.groupBy("file").agg(F.max(length).alias("all"), F.max(last_end).alias("since"), F.max(F.col("docs_before") + F.size("ends")).alias("docs"))
    rest = tail.where(F.col("all") > F.col("since")).select("file", F.col("docs").cast("long").alias("doc_no"), F.col("since").alias("start"), (F.col("all") - F.col("since")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)


def count_documents(docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, file, doc_no, start, n_tokens, closed) of each row of ``docs`` (doc_id, text), which are written to flat files in ``folder`` first.

    A null text has no tokens, a null doc_id stays null, repeated rows each get a row; no rows give none.
    """
    places = write_files(docs, folder)
    counted = count_files(docs.sparkSession, folder).withColumn("part", F.regexp_extract("file", r"part-([0-9]+)-[^/]*$", 1).cast("int"))
    counted = stored(counted, "counted")
    a, b = (x.groupBy("part").agg(F.count("*").alias(n)) for x, n in ((counted.where("closed"), "x"), (places, "y")))
    if not a.join(b, "part", "full").where(~F.col("x").eqNullSafe(F.col("y"))).isEmpty():
        raise RuntimeError("the documents were dealt out otherwise when their places were noted")
    return places.join(counted, ["part", "doc_no"]).select("doc_id", F.regexp_extract("file", r"[^/]*$", 0).alias("file"), "doc_no", "start", "n_tokens", "closed")


def op9_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_documents(read_table(spark, sf_dir, "documents"), f"{scratch_root(spark)}/token-files-{uuid.uuid4().hex}")
