"""Removal of repeated token windows by Rabin-Karp hashes.

Every window of ``window`` consecutive words gets rolling hashes over the words' own hashes. A window whose word sequence
also starts earlier (smaller document id, or earlier in the same document) is a repeat; words under repeats go, which
merges overlapping repeats into maximal intervals. Three rounds keep what is shuffled small without losing a window:

1. Anchors. Among the hashed ``window // 5 * 2``-word parts inside a window the smallest hash is its anchor, so equal
   windows have equal anchors, and a document has about one anchor for each seven words. Anchors are counted in Spark; a
   window whose anchor occurs once in the corpus occurs once itself.
2. Windows. All other windows are counted under 96 bits of two rolling hashes, and the earliest start of each is found.
   Windows count as equal when these are; both rest on one mixed 64-bit hash of each word, so two different words in one
   place collide with a chance of some V * V / 2^65 for V different words (3e-8 for a billion).
3. Each document with repeats is cut.

Anchors and windows travel packed by hash range, many to a row, and a task sends a hash once for each few MB of text
however often it met it there, so a passage that a third of all documents share is a small part of what is counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import arrow_map, partitions, read_table, stored

WINDOW = 20
#: Bytes of text that are hashed at a time, and words whose windows are.
_SEGMENT = 1 << 20
_RUN = 1 << 19
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Bits of the filter of document ids: 32 MB at most, whatever the input; beyond, more rows pass it in vain.
_FILTER_BITS = 1 << 28
#: Stands for a null id where ids are compared; ``missing`` tells such rows from one that has this very id.
_NULL_ID = np.iinfo(np.int64).max


@lru_cache(maxsize=8)
def _powers(multiplier: int, n: int) -> np.ndarray:
    x = np.full(n, multiplier, np.uint64)
    x[0] = 1
    return np.multiply.accumulate(x)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ranges(values: np.ndarray, begins: np.ndarray, ends: np.ndarray, multiplier: int, most: int) -> np.ndarray:
    """Rabin-Karp hashes of ``values[begin:end]`` for each pair, by differences of one prefix sum; begins are at most ``most``.

    A difference is shifted to the common power ``most``, so equal ranges have equal hashes wherever they stand.
    """
    power = _powers(multiplier, max(most, len(values)) + 1)
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(values * power[: len(values)], dtype=np.uint64)])
    return (prefix[ends] - prefix[begins]) * power[most - begins]


def words_in(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, begin of each word, its end, its row) of a string array; null texts have no words."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.empty(0, np.uint8)
    offsets = offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    begins = np.flatnonzero(first)
    return data, begins, np.flatnonzero(last) + 1, np.searchsorted(offsets, begins, "right") - 1


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of each word's bytes."""
    out, at = np.empty(len(begins), np.uint64), 0
    while at < len(begins):
        to = max(at + 1, int(np.searchsorted(ends, begins[at] + _SEGMENT, "right")))
        base = begins[at]
        values = _letters()[data[base : ends[to - 1]]]
        out[at:to] = _ranges(values, begins[at:to] - base, ends[at:to] - base, _MULTIPLIERS[0], _SEGMENT)
        at = to
    return _mix(out)


def rolling(words: np.ndarray, width: int, multiplier: int) -> np.ndarray:
    """The hash of each run of ``width`` words (one for each place where a run fits)."""
    n = max(0, len(words) - width + 1)
    out = np.empty(n, np.uint64)
    for at in range(0, n, _RUN):
        part = words[at : min(at + _RUN, n) + width - 1]
        k = np.arange(len(part) - width + 1)
        out[at : at + len(k)] = _ranges(part, k, k + width, multiplier, _RUN)
    return _mix(out)


def _slide(x: np.ndarray, width: int, pick: Callable) -> np.ndarray:
    """``pick`` (minimum or maximum) over each run of ``width`` values."""
    have = 1
    while 2 * have <= width:
        x = pick(x[:-have], x[have:]) if len(x) > have else x[:0]
        have *= 2
    rest = width - have
    return pick(x[: len(x) - rest], x[rest:]) if rest and len(x) > rest else x[:0] if rest else x


class Windows:
    """The windows of a batch of documents, whose words follow each other in one array."""

    def __init__(self, texts: pa.Array, window: int) -> None:
        self.data, self.begins, self.ends, self.row = words_in(texts)
        self.words = word_hashes(self.data, self.begins, self.ends)
        self.window, self.part = window, max(1, window // 5 * 2)
        n = max(0, len(self.words) - window + 1)
        self.whole = self.row[:n] == self.row[window - 1 :] if n else np.empty(0, bool)
        #: the place of each word in its document
        self.place = np.arange(len(self.row)) - np.searchsorted(self.row, self.row, "left")

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor of each window, hash of each part, whether that part is some whole window's anchor)."""
        parts = rolling(self.words, self.part, _MULTIPLIERS[1])
        span = self.window - self.part + 1
        least = _slide(parts, span, np.minimum)[: len(self.whole)]
        padded = np.zeros(len(parts) + span - 1, np.uint64)
        padded[span - 1 : span - 1 + len(least)] = np.where(self.whole, least, 0)
        return least, parts, (_slide(padded, span, np.maximum) == parts) & (parts != 0) if len(least) else np.zeros(len(parts), bool)


#: What a payload holds, column after column: single anchors, anchors met twice, settled anchors, window starts, settled starts.
_PACKED = "bucket int, payload binary"
_KINDS = {0: ("<u8", "<i8"), 1: ("<u8",), 2: ("<i8", "<u8"), 3: ("<u8", "<u4", "<i8", "<i8", "<i4"), 4: ("<i8", "<i8", "<i4")}


def _deal(kind: int, key: np.ndarray, columns: list[np.ndarray], buckets: int) -> Iterator[tuple[int, bytes]]:
    """The columns, packed by range of the hash ``key``."""
    if not len(key):
        return
    which = ((key >> np.uint64(40)).astype(np.int64) * buckets) >> 24
    order = np.argsort(which, kind="stable")
    which = which[order]
    cuts = np.flatnonzero(np.diff(which)) + 1
    columns = [c.astype(k, copy=False) for c, k in zip(columns, _KINDS[kind], strict=True)]
    for at, idx in zip(np.append(0, cuts).tolist(), np.split(order, cuts), strict=True):
        yield int(which[at]), bytes([kind]) + len(idx).to_bytes(4, "little") + b"".join(c[idx].tobytes() for c in columns)


def _open(payloads: list[bytes], kind: int) -> list[np.ndarray]:
    got: list[list[np.ndarray]] = [[] for _ in _KINDS[kind]]
    for p in payloads:
        if p[0] == kind:
            n, at = int.from_bytes(p[1:5], "little"), 5
            for g, k in zip(got, _KINDS[kind], strict=True):
                g.append(np.frombuffer(p, k, n, at))
                at += g[-1].nbytes
    return [np.concatenate(g) if g else np.empty(0, k) for g, k in zip(got, _KINDS[kind], strict=True)]


def _packed_rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], ["bucket", "payload"])


def _batches(batches: Iterator[pa.RecordBatch], most: int = 6_000_000) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(document ids, texts) in runs of about ``most`` bytes; null ids sort after all others."""
    from weftline.llm.tokens import slices

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for begin, end in slices(batch.column(1), most):
            held.append(batch.slice(begin, end - begin))
            size += held[-1].column(1).nbytes
            if size >= most:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[np.ndarray, pa.Array]:
    t = pa.Table.from_batches(held)
    return np.array(pc.fill_null(t.column(0), _NULL_ID), np.int64), t.column(1).combine_chunks()


def _split(payload_rows: DataFrame, buckets: int) -> DataFrame:
    """Each bucket's rows in a partition of their own."""
    return payload_rows.repartitionById(buckets, F.col("bucket"))


def repeated_anchors(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """(doc_id, values): per document the anchors that occur at two or more places of the corpus."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _batches(batches):
            w = Windows(texts, window)
            _, parts, chosen = w.anchors()
            spots = np.flatnonzero(chosen)
            h, doc = parts[spots], ids[w.row[spots]]
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            first, size = _groups(h)
            again = np.repeat(size > 1, size)
            settled = again & ~np.concatenate([[False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])])
            single = np.flatnonzero(~again)
            single = single[np.argsort(doc[single], kind="stable")]  # ids in order pack well
            twice = h[first[size > 1]]
            rows = [*_deal(0, h[single], [h[single], doc[single]], buckets), *_deal(1, twice, [twice], buckets), *_deal(2, _mix(doc[settled].view(np.uint64)), [doc[settled], h[settled]], buckets)]
            if rows:
                yield _packed_rows(rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        payloads = [p.as_py() for b in batches for p in b.column(1)]
        h, doc = _open(payloads, 0)
        (twice,) = _open(payloads, 1)
        settled, values = _open(payloads, 2)
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        _, size = _groups(h)
        again = np.repeat(size > 1, size) | np.isin(h, twice)
        yield from _return(2, [np.concatenate([doc[again], settled]), np.concatenate([h[again], values])], buckets)

    return _per_document(_split(docs.select("doc_id", "text").mapInArrow(send, _PACKED), buckets).mapInArrow(count, _PACKED), buckets)


def _groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, size) of each run of equal values."""
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
    return first, np.diff(np.append(first, len(x)))


def _return(kind: int, columns: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """What was found, packed by range of the documents' hashes."""
    rows = list(_deal(kind, _mix(columns[0].view(np.uint64)), columns, buckets))
    if rows:
        yield _packed_rows(rows)


def _per_document(found: DataFrame, buckets: int, tagged: bool = False) -> DataFrame:
    """(doc_id, values), or (doc_id, tag, values): one row for each document, with its values packed one after another."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, *tag, value = _open([p.as_py() for b in batches for p in b.column(1)], 4 if tagged else 2)
        if not len(doc):
            return
        order = np.lexsort((*tag, doc))
        doc, value, tag = doc[order], value[order], [t[order] for t in tag]
        new = np.concatenate([[True], doc[1:] != doc[:-1]])
        for t in tag:
            new[1:] |= t[1:] != t[:-1]
        begins = np.flatnonzero(new)
        sizes = np.diff(np.append(begins, len(doc)))
        for k in range(0, len(begins), 20_000):
            part = slice(k, k + 20_000)
            values = [value[a : a + n].tobytes() for a, n in zip(begins[part].tolist(), sizes[part].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[begins[part]]), *(pa.array(t[begins[part]]) for t in tag), pa.array(values, pa.binary())], ["doc_id", *["tag" for _ in tag], "values"])

    return _split(found, buckets).mapInArrow(gather, "doc_id long, tag long, values binary" if tagged else "doc_id long, values binary")


def repeated_windows(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """(doc_id, tag, values): per document the starts of windows that start earlier elsewhere.

    ``docs`` has (doc_id, text, anchors, tag): the packed anchors that occur twice or more, and a hash of the text, which
    tells texts under one id apart.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts, anchors, tags in _with_values(batch):
                w = Windows(texts, window)
                least, _, _ = w.anchors()
                # an anchor counts only for its own document: the row is mixed into what is looked up
                rows = np.arange(len(texts), dtype=np.uint64) * np.uint64(_MULTIPLIERS[3])
                lengths = [len(a) // 8 for a in anchors]
                wanted = np.frombuffer(b"".join(anchors), "<u8") ^ np.repeat(rows, lengths)
                spots = np.flatnonzero(w.whole)
                spots = spots[np.isin(least[spots] ^ rows[w.row[spots]], wanted)]
                h = rolling(w.words, window, _MULTIPLIERS[2])[spots]
                x = (rolling(w.words, window, _MULTIPLIERS[3])[spots] >> np.uint64(32)).astype("<u4")
                doc, tag, at = ids[w.row[spots]], tags[w.row[spots]], w.place[spots].astype("<i4")
                first, later = _earliest(h, x, doc, tag, at)
                first = first[np.argsort(doc[first], kind="stable")]
                out = [*_deal(3, h[first], [h[first], x[first], doc[first], tag[first], at[first]], buckets), *_deal(4, _mix(doc[later].view(np.uint64)), [doc[later], tag[later], at[later]], buckets)]
                if out:
                    yield _packed_rows(out)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        payloads = [p.as_py() for b in batches for p in b.column(1)]
        h, x, doc, tag, at = _open(payloads, 3)
        settled = _open(payloads, 4)
        _, later = _earliest(h, x, doc, tag, at)
        yield from _return(4, [np.concatenate([c[later], s]) for c, s in zip((doc, tag, at), settled, strict=True)], buckets)

    return _per_document(_split(docs.mapInArrow(send, _PACKED), buckets).mapInArrow(count, _PACKED), buckets, True)


def _earliest(h: np.ndarray, x: np.ndarray, doc: np.ndarray, tag: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts before which a window does not start, all other starts) of each window.

    The first are those of the smallest document; where several texts share its id, the earliest start in each of them.
    """
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.lexsort((at, tag, doc, x, h))
    h, x, doc, tag, at = h[order], x[order], doc[order], tag[order], at[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (x[1:] != x[:-1])])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    text = new | np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
    begin = np.flatnonzero(text)[np.cumsum(text) - 1]
    least = doc == doc[first]
    return order[least & text], order[~least | (at != at[begin])]


def _with_values(batch: pa.RecordBatch, most: int = 6_000_000) -> Iterator[tuple[np.ndarray, pa.Array, list[bytes], np.ndarray]]:
    from weftline.llm.tokens import slices

    for begin, end in slices(batch.column(1), most):
        part = batch.slice(begin, end - begin)
        yield np.array(pc.fill_null(part.column(0), _NULL_ID), np.int64), part.column(1), [x or b"" for x in part.column(2).to_pylist()], np.array(pc.fill_null(part.column(3), 0), np.int64)


def _spots(ids: np.ndarray, bits: int) -> np.ndarray:
    x = ids.view(np.uint64)
    return np.concatenate([_mix(x ^ np.uint64(m)) for m in _MULTIPLIERS]) & np.uint64(bits - 1)


def id_filter(found: DataFrame, most_bits: int = _FILTER_BITS) -> tuple[np.ndarray, int]:
    """A Bloom filter of the doc_id column, built in parts: (bytes, bits), of ``most_bits`` bits at most."""
    n = found.count()
    bits = min(most_bits, 1 << max(13, (16 * n).bit_length()))

    def fill(batch: pa.RecordBatch) -> pa.RecordBatch:
        spots = np.unique(_spots(np.array(batch.column(0), np.int64), bits))
        word, at = spots >> np.uint64(6), spots & np.uint64(63)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        masks = np.bitwise_or.reduceat(np.uint64(1) << at, first) if len(spots) else np.empty(0, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(word[first].astype(np.int64)), pa.array(masks.view(np.int64))], ["word", "mask"])

    # tasks send the words that they set, which are joined before and after the shuffle; ``most_bits`` reach the driver
    words = arrow_map(found.select("doc_id"), fill, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    return out.view(np.uint8), bits


def _may_hold(flags: np.ndarray, bits: int, ids: np.ndarray) -> np.ndarray:
    at = _spots(ids, bits).reshape(4, -1)
    return ((flags[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(0)


def _cut(texts: pa.Array, starts: list[bytes], window: int) -> tuple[list[int], list[int], list[str]]:
    """(words, words removed, SHA-256 of the rest) of each text, whose repeated windows start at ``starts``."""
    data, begins, ends, row = words_in(texts)
    first = np.searchsorted(row, np.arange(len(texts) + 1), "left")
    raw = data.tobytes()
    n, gone, digest = [], [], []
    for k, packed in enumerate(starts):
        a, b = int(first[k]), int(first[k + 1])
        keep = np.ones(b - a, bool)
        if packed:
            at = np.frombuffer(packed, "<i4")
            cover = np.zeros(b - a + 1, np.int64)
            np.add.at(cover, at, 1)
            np.subtract.at(cover, at + window, 1)
            keep = np.cumsum(cover[:-1]) == 0
        kept = np.flatnonzero(keep) + a
        n.append(b - a)
        gone.append(b - a - len(kept))
        digest.append(hashlib.sha256(b" ".join([raw[i:j] for i, j in zip(begins[kept].tolist(), ends[kept].tolist(), strict=True)])).hexdigest())
    return n, gone, digest


def dedup_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of ``docs``.

    A null text has no words. A null doc_id counts as larger than all others. Of different texts that share a doc_id, or
    have none, none is earlier than the other; rows repeated as a whole are one document. Texts shorter than a window lose
    nothing.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("tag"))
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(1 << 20, max(partitions(spark), size >> 24))
    anchors = stored(repeated_anchors(docs, window, buckets), "anchors")
    windows = stored(repeated_windows(_pass(docs, anchors, True).join(anchors, "doc_id").select("doc_id", "text", "values", "tag"), window, buckets), "windows")
    rows = _pass(docs, windows, False, window).join(windows, ["doc_id", "tag"], "left").select("doc_id", "text", "values", "tag", "n_words", "kept_sha256", "missing")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [None if gone else i for i, gone in zip(batch.column(0).to_pylist(), batch.column(6).to_pylist(), strict=True)]
            done = batch.column(5).is_valid().to_numpy(zero_copy_only=False)
            n, gone, digest = batch.column(4).to_pylist(), [0] * batch.num_rows, batch.column(5).to_pylist()
            at = 0
            todo = np.flatnonzero(~done)
            part = batch.filter(pa.array(~done))
            for _, texts, starts, _ in _with_values(part.select([0, 1, 2, 3])):
                for i, *x in zip(todo[at : at + len(texts)].tolist(), *_cut(texts, starts, window), strict=True):
                    n[i], gone[i], digest[i] = x
                at += len(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _pass(docs: DataFrame, found: DataFrame, drop: bool, window: int = WINDOW) -> DataFrame:
    """``docs`` for a join with ``found``. Only texts of documents that may be in it travel: a bounded filter of the ids
    stops the others, which are dropped or, with ``drop`` false, go on without text as they are done."""
    flags, bits = id_filter(found)
    shared = docs.sparkSession.sparkContext.broadcast(flags.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            ids, missing = np.array(pc.fill_null(batch.column(0), _NULL_ID), np.int64), pc.is_null(batch.column(0))
            there = _may_hold(known, bits, ids)
            kept, tags = batch.column(1).filter(pa.array(there)), batch.column(2).filter(pa.array(there))
            if drop:
                if len(kept):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[there]), kept, tags], ["doc_id", "text", "tag"])
                continue
            if len(kept):
                yield pa.RecordBatch.from_arrays([pa.array(ids[there]), kept, tags, pa.nulls(len(kept), pa.int64()), pa.nulls(len(kept), pa.string()), missing.filter(pa.array(there))], ["doc_id", "text", "tag", "n_words", "kept_sha256", "missing"])
            rest, other, missing = batch.filter(pa.array(~there)), ids[~there], missing.filter(pa.array(~there))
            at = 0
            for _, texts, starts, _ in _with_values(pa.RecordBatch.from_arrays([rest.column(0), rest.column(1), pa.nulls(len(rest), pa.binary()), rest.column(2)], ["a", "b", "c", "d"])):
                n, _, digest = _cut(texts, starts, window)
                yield pa.RecordBatch.from_arrays([pa.array(other[at : at + len(n)]), pa.nulls(len(n), pa.string()), pa.nulls(len(n), pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.string()), missing.slice(at, len(n))], ["doc_id", "text", "tag", "n_words", "kept_sha256", "missing"])
                at += len(n)

    return docs.mapInArrow(run, "doc_id long, text string, tag long" + ("" if drop else ", n_words long, kept_sha256 string, missing boolean"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(read_table(spark, sf_dir, "documents"))
