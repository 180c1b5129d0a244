"""Near-duplicates by SimHash and exact Jaccard similarity of word shingles.

Every set of shingles gets a SimHash fingerprint. The byte-position index with count filtering (``simhash.links``) proposes
pairs of fingerprints within two bits, and the sets behind them are compared in full. Two sets of a similarity of 0.8 differ
in some ten of 64 bits, where no number of shared bytes is guaranteed, so what the index cannot propose comes from an exact
set similarity join by prefix filtering.

Under any one order of all shingles, two sets of a similarity of 0.8 or more share a shingle among the first fifth (and
one) of each. Only these prefixes are dealt out by shingle; sets that meet are then compared in full, so no pair of that
similarity is lost and none below it is linked. Shingles that a sample finds common come last in the order, which keeps
them out of most prefixes; the order changes the cost, never the result. What two sets share lies behind the first shingle
they share, so a pair whose rests at a shared shingle are too small is not compared there.

Short lists make all pairs. In a long one each set is first paired with a few of those next to it in the order of their
fingerprints; where that leaves members in different components, those of different components are tried by sketches of a
few hundred bytes inside the list, and only pairs that pass become rows. Sets are compared in two rounds: a few pairs a set
first, then whatever still lies between components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import simhash
from weftline.llm.common import arrow_map, brief_shuffles, dropped, join_hot, partitions, stored, texts
from weftline.llm.simhash import SEED, components

SHINGLE = 5
#: The least similarity that links, as a fraction.
NEAR = (4, 5)
#: One set in so many is counted for common shingles, which are those of COMMON or more; the most common KNOWN of them are sent out.
SAMPLE, COMMON, KNOWN = 20, 3, 200_000
#: Lists up to this length compare all pairs at once.
SHORT = 12
#: Counts in a sketch, of two bytes; a count that is FULL may stand for more.
BUCKETS, FULL = 256, 65_535
#: In a long list, fingerprints are sorted after turns by so many bits, and each is tried with so many next to it.
TURNS, BESIDE = (0, 16, 32, 48), 4
#: Numbers of rows up to this are broadcast (8 bytes each).
BROADCAST_ROWS = 2_000_000


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted, distinct hashes of a text's word shingles; a text of fewer words is one shingle, one of none has none.

    A-Z are lower-cased and words split at ASCII white space.
    """
    words = text.lower().split()  # on bytes both touch ASCII only
    runs = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)] if words else []
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64).view(np.int64))


def _hash_of(column: str) -> Column:
    return F.xxhash64(F.col(column).cast("string"))


def _sketch(s: np.ndarray) -> bytes:
    """How many hashes of a set fall into each of BUCKETS: two sets share at most the sum of the smaller counts."""
    counts = np.bincount((s.view(np.uint64) >> np.uint64(40)).astype(np.int64) % BUCKETS, minlength=BUCKETS)
    return np.minimum(counts, FULL).astype("<u2").tobytes()


def _may_share(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The most shingles that sets with the sketches ``x`` and ``y`` (rows) can share."""
    low = np.minimum(x, y)
    most = low.sum(1, dtype=np.int64)
    most[(low == FULL).any(1)] = np.iinfo(np.int32).max
    return most


def _fingerprint(s: np.ndarray) -> int:
    """The SimHash of a set of hashes, as a signed long: bit by bit their majority; 0 for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(s), simhash._CHUNK):
        spots = s[at : at + simhash._CHUNK].view(np.uint8).reshape(-1, 8).astype(np.int64) + np.arange(0, 2048, 256)
        ones += (np.bincount(spots.ravel(), minlength=2048).reshape(8, 256) @ simhash._BITS).ravel()
    return int(np.packbits(2 * ones > len(s), bitorder="little").view("<i8")[0])


def _sets(docs: DataFrame, shingle: int, common: np.ndarray) -> DataFrame:
    """(doc_id, text_hash, key, n, fp, sketch, prefix) for each row: ``key`` is a hash of the set of ``n`` shingles, ``fp``
    its fingerprint and ``prefix`` its first ones in the order that has ``common`` shingles last."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _hash_of("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(common)
    over, under = NEAR

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, sizes, fps, sketches, prefixes = [], [], [], [], []
        for t in texts(batch.column(2)):
            s = shingles(t, shingle)
            n = len(s)
            known = shared.value
            late = known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s if len(known) else np.zeros(n, bool)
            keys.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
            sizes.append(n)
            fps.append(_fingerprint(s))
            sketches.append(_sketch(s))
            prefixes.append(np.concatenate([s[~late], s[late]])[: n - -(-over * n // under) + 1])
        ends = np.concatenate([[0], np.cumsum([len(x) for x in prefixes])]).astype(np.int32)
        arrays = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)))
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), pa.array(sketches, pa.binary()), arrays], ["doc_id", "text_hash", "key", "n", "fp", "sketch", "prefix"])

    return arrow_map(rows, run, "doc_id long, text_hash long, key long, n long, fp long, sketch binary, prefix array<long>")


def _whole(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(key, shingles) of the sets whose texts' hashes are in ``wanted`` (text_hash, key): only those texts are split again."""
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    rows = docs.select(_hash_of("text").alias("text_hash"), F.col("text").cast("string").alias("text")).join(few, "text_hash").dropDuplicates(["key"]).select("key", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, shingle) for t in texts(batch.column(1))]
        ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        arrays = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
        return pa.RecordBatch.from_arrays([batch.column(0), arrays], ["key", "shingles"])

    return arrow_map(rows, run, "key long, shingles array<long>")


def _common(docs: DataFrame, shingle: int) -> np.ndarray:
    """Shingles that a sample of the texts finds common, KNOWN at most."""
    some = docs.select(_hash_of("text").alias("h"), F.col("text").cast("string").alias("text")).where(F.pmod("h", F.lit(SAMPLE)) == 0).dropDuplicates(["h"]).select("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, shingle) for t in texts(batch.column(0))]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))], ["h"])

    counts = arrow_map(some, run, "h long").groupBy("h").count().where(F.col("count") >= COMMON)
    return np.sort(counts.orderBy(F.desc("count")).limit(KNOWN).select("h").toArrow().column(0).to_numpy())


def _fits(na, nb, ra, rb):
    """Whether sets of ``na`` and ``nb`` shingles can be as similar as NEAR asks, with ``ra`` and ``rb`` left from a first shared one on."""
    over, under = NEAR
    need = over * (na + nb)
    return (under * na >= over * nb) & (under * nb >= over * na) & ((over + under) * ra >= need) & ((over + under) * rb >= need)


def _proposed(sets: DataFrame) -> DataFrame:
    """(a, b): pairs a > b of sets whose fingerprints the byte-position index links, enough to connect all that it connects."""
    first = stored(sets.where("n > 0").groupBy("fp").agg(F.min("key").alias("first")), "fingerprints")
    found = stored(simhash.links(first.select("fp")), "linked")
    x, y = (first.select(F.col("fp").alias(k), F.col("first").alias(f"first_{k}")) for k in "ab")
    linked = found.join(x, "a").join(y, "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    equal = sets.where("n > 0").join(first, "fp").select(F.col("key").alias("a"), F.col("first").alias("b"))
    both = equal.unionByName(linked).where("a <> b")
    out = stored(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "proposed")
    dropped(first, found)
    return out


def _in_lists(fn: Callable[[list[np.ndarray]], list[np.ndarray]], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: ``fn`` over the columns of each list of two members or more; the first column, sorted, names the list.

    Lists are streamed; one list is held at a time. ``fn`` gives columns, which are named ``names``.
    """

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [np.frombuffer(b"".join(c.to_pylist()), "<u2").reshape(-1, BUCKETS) if pa.types.is_binary(c.type) else c.to_numpy() for c in batch.columns]

    def flush(x: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        begins = np.flatnonzero(np.concatenate([[True], np.diff(x[0]) != 0]))
        counts = np.diff(np.append(begins, len(x[0])))
        out = [fn([c[at : at + n] for c in x]) for at, n in zip(begins[counts > 1].tolist(), counts[counts > 1].tolist(), strict=True)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            x = columns(batch)
            cut = int(np.searchsorted(x[0], x[0][-1]))  # the last list may go on in the next batch
            if held and (cut or held[0][0][0] != x[0][0]):
                head = int(np.searchsorted(x[0], held[0][0][0], "right"))
                yield from flush([np.concatenate(c) for c in zip(*held, [c[:head] for c in x], strict=True)])
                yield from flush([c[head:cut] for c in x]) if cut > head else ()
                held = []
            elif cut:
                yield from flush([c[:cut] for c in x])
            held.append([c[cut:].copy() for c in x])
        if held:
            yield from flush([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def _candidates(sets: DataFrame) -> DataFrame:
    """(a, b, h, n, rest): pairs a > b of short lists; of a long one, ``h``, its members a, b = a, with size and rest.

    ``sets`` has each set once. A list holds the sets that have a shingle in their prefix, with the set's size and how many
    of its shingles are left from there on. Pairs have 0 in ``n``.
    """
    own = sets.select("key", "n", F.posexplode("prefix").alias("at", "h"))
    rows = own.select("h", "key", F.shiftleft("n", 31).bitwiseOR(F.col("n") - F.col("at")).alias("size"))
    lists = rows.repartition(partitions(sets.sparkSession), "h").sortWithinPartitions("h", "key")

    def pairs(x: list[np.ndarray]) -> list[np.ndarray]:
        h, key, size, rest = x[0], x[1], x[2] >> 31, x[2] & ((1 << 31) - 1)
        if len(key) > SHORT:
            return [key, key, h, size, rest]
        j, i = np.triu_indices(len(key), 1)
        fits = _fits(size[i], size[j], rest[i], rest[j])
        i, j = i[fits], j[fits]
        none = np.zeros(len(i), np.int64)
        return [key[i], key[j], none, none, none]

    return lists.mapInArrow(_in_lists(pairs, ["a", "b", "h", "n", "rest"]), "a long, b long, h long, n long, rest long")


def _beside(members: DataFrame) -> DataFrame:
    """(a, b): of the long lists' ``members``, each with the few most promising of those next to it by fingerprint."""

    def near(x: list[np.ndarray]) -> list[np.ndarray]:
        _, key, n, rest, _, fp, sketch = x
        fp, out = fp.view(np.uint64), []
        for turn in TURNS:
            order = np.argsort((fp << np.uint64(turn)) | (fp >> np.uint64(64 - turn)) if turn else fp, kind="stable")
            best, other = np.full(len(key), -1.0), np.zeros(len(key), np.int64)
            for k in range(1, min(BESIDE, len(key) - 1) + 1):
                i, j = order[k:], order[:-k]
                fits = _fits(n[i], n[j], rest[i], rest[j])
                i, j = i[fits], j[fits]
                score = _may_share(sketch[i], sketch[j]) / (n[i] + n[j])
                for me, it in ((i, j), (j, i)):  # in each, a member is named once at most
                    more = score > best[me]
                    best[me[more]], other[me[more]] = score[more], it[more]
            enough = np.flatnonzero((NEAR[0] + NEAR[1]) * best >= NEAR[0] - 1e-9)
            out.append([key[enough], key[other[enough]], best[enough]])
        return [np.concatenate(c) for c in zip(*out, strict=True)]

    lists = members.select("h", "key", "n", "rest", "root", "fp", "sketch").repartition(partitions(members.sparkSession), "h").sortWithinPartitions("h", "key")
    found = lists.mapInArrow(_in_lists(near, ["me", "other", "score"]), "me long, other long, score double")
    best = found.groupBy("me").agg(F.slice(F.sort_array(F.collect_set(F.struct("score", "other")), False), 1, BESIDE).alias("best"))
    pairs = best.select("me", F.explode("best.other").alias("other"))
    return pairs.select(F.greatest("me", "other").alias("a"), F.least("me", "other").alias("b")).distinct()


def _between(members: DataFrame) -> DataFrame:
    """(a, b): of the long lists' ``members``, all pairs of different components that may match by size, place and sketch."""

    def tried(x: list[np.ndarray]) -> list[np.ndarray]:
        _, key, n, rest, root, _, sketch = x
        groups, of, counts = np.unique(root, return_inverse=True, return_counts=True)
        out = [np.zeros((0, 2), np.int64)]
        if len(groups) > 1:
            order = np.argsort(-counts[of], kind="stable")  # members of the largest component are never on the left
            key, n, rest, of, sketch = key[order], n[order], rest[order], of[order], sketch[order]
            for i in range(int(counts.max()), len(key)):
                j = np.flatnonzero((of[:i] != of[i]) & _fits(n[i], n[:i], rest[i], rest[:i]))
                j = j[(NEAR[0] + NEAR[1]) * _may_share(sketch[i][None], sketch[j]) >= NEAR[0] * (n[i] + n[j])]
                out.append(np.stack([np.maximum(key[i], key[j]), np.minimum(key[i], key[j])], 1))
        return list(np.concatenate(out).T)

    lists = members.select("h", "key", "n", "rest", "root", "fp", "sketch").repartition(partitions(members.sparkSession), "h").sortWithinPartitions("h", "key")
    return lists.mapInArrow(_in_lists(tried, ["a", "b"]), "a long, b long").distinct()


def _may_match(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that can be as similar as NEAR asks by the counts of their sketches; none that are is lost."""
    side = lambda k: sets.select(F.col("key").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    over, under = NEAR

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, BUCKETS) for k in (4, 5))
        keep = (over + under) * _may_share(x, y) >= over * (batch.column(2).to_numpy() + batch.column(3).to_numpy())
        return batch.select([0, 1]).filter(pa.array(keep))

    return arrow_map(both.select("a", "b", "na", "nb", "sa", "sb"), run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as NEAR asks."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    wanted = stored(sets.select("key", "text_hash").join(ids, "key", "left_semi"), "wanted")
    own = stored(_whole(docs, wanted, shingle), "compared")
    left, right = (own.select(F.col("key").alias(k), F.col("shingles").alias(f"s{k}")) for k in "ab")
    both = pairs.join(left, "a").join(right, "b")
    over, under = NEAR
    shared = F.size(F.array_intersect("sa", "sb"))
    out = stored(both.where((over + under) * shared >= over * (F.size("sa") + F.size("sb"))).select("a", "b"), "similar")
    dropped(wanted, own)
    return out


def similar_components(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, root) for each row: rows share a root if a chain of similar sets, or of equal ones, joins them.

    A first round compares the pairs that the byte-position index proposes, one pair of short lists a set and a few pairs of
    long lists a set. A second one compares all pairs of lists that are left between the components of the first.
    """
    every = stored(_sets(docs, shingle, _common(docs, shingle)), "sets")
    rows = stored(every.select("doc_id", "text_hash", "key"), "row-sets")
    whole = stored(every.drop("doc_id").dropDuplicates(["key"]), "distinct-sets")
    dropped(every)
    sets = stored(whole.select("key", "text_hash", "n", "fp", "sketch"), "sketches")
    met = stored(_candidates(whole), "candidates")
    dropped(whole)
    pairs = stored(met.where("a <> b").select("a", "b").distinct(), "met-pairs")
    members = met.where("a = b").select("h", F.col("a").alias("key"), "n", "rest")
    members = stored(members.join(sets.select("key", "fp", "sketch"), "key"), "members")
    dropped(met)
    proposed = _proposed(sets)
    one = pairs.groupBy("a").agg(F.min("b").alias("b"))
    few = proposed.unionByName(one).unionByName(_beside(members.withColumn("root", F.col("key")))).distinct()
    first = stored(_may_match(few, sets), "first-pairs")
    edges = _verified(first, docs, sets, shingle)
    roots = components(edges)
    ra, rb = (roots.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}")) for k in "ab")
    short = pairs.join(ra, "a", "left").join(rb, "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    rooted = members.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    rest = _may_match(short, sets).unionByName(_between(rooted)).distinct().join(first, ["a", "b"], "left_anti")
    rest = stored(rest, "rest-pairs")
    dropped(members, pairs, proposed)
    if not rest.isEmpty():
        roots = components(edges.unionByName(_verified(rest, docs, sets, shingle)))
    # texts with one set may be a third of all rows
    by_key = rows.groupBy("key").agg(F.count("*").alias("n")).join(roots.withColumnRenamed("node", "key"), "key", "left")
    by_key = stored(by_key.select("key", "n", F.coalesce("root", "key").alias("root")), "by-set")
    dropped(sets, first, rest)
    return join_hot(rows, by_key, "key", "n").select("doc_id", "text_hash", "root")


def keep_one_similar(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` for each component, with all columns: the one of the smallest doc_id, a null one last.

    Rows are told apart by doc_id and text, so different texts under one id, or without one, each count. Texts without
    words are copies of each other. Rows that go are named by (doc_id, hash of text); up to BROADCAST_ROWS names are
    broadcast, so that no text is shuffled but those of rows that are repeated as a whole.
    """
    with brief_shuffles(docs.sparkSession):
        found = similar_components(docs, shingle)
        rows = stored(found.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n")), "rows")
        order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_hash"))
        best = stored(rows.groupBy("root").agg(F.min(order).alias("best"), F.count("*").alias("members")), "best")
        marked = join_hot(rows, best, "root", "members").select("doc_id", "text_hash", "n", (order == F.col("best")).alias("stays"))
        names = stored(marked.where(~F.col("stays") | (F.col("n") > 1)).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text_hash"), "stays"), "named")
        dropped(rows, best)
    few = F.broadcast(names) if names.count() <= BROADCAST_ROWS else names
    hashed = docs.withColumn("_hash_of_text", _hash_of("text"))
    tagged = hashed.join(few, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_hash_of_text") == F.col("_text_hash")), "left").where(F.coalesce("stays", F.lit(True)))
    once = tagged.where("stays IS NULL").select(*docs.columns)
    return once.unionByName(tagged.where("stays").dropDuplicates(["_id", "_hash_of_text"]).select(*docs.columns))
