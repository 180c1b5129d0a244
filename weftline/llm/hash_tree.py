"""Sharding by a hierarchical weighted hash tree.

A layout is regions of racks of shards, each node with a weight. A row descends from the root: on every level each child
draws ``-ln(u) / weight`` with ``u`` hashed from the row's key and the child's name, and the smallest draw wins, so a
child takes rows in proportion to its weight. A draw depends on nothing but key, child and weight: when weights change,
a row moves only at a node on the way to a changed subtree, and rows below unchanged subtrees stay where they are.

Shards are the first places of a tree of full racks and regions; of the last region some places may still be empty. There
each child's draw is its node's draw plus what the child is behind the node's best child. So the draws of all places,
filled or empty, are what they would be if each were drawn alone, and the smallest of the filled ones wins. Filling
one more place, at any number of shards, can only make that place the smallest: a new shard takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import partitions, read_table, stored

SHARDS = 16


@dataclass(frozen=True)
class Node:
    name: str
    weight: float
    children: tuple[Node, ...] = ()
    shard: int | None = None


def layout(shards: int, per_rack: int = 4, racks: int = 2) -> tuple[Node, ...]:
    """Whole regions with a place for each of ``shards`` equal shards: racks of ``per_rack``, regions of ``racks`` racks."""
    if shards < 1:
        raise ValueError("a layout needs a shard")
    room = per_rack * racks
    leaves = [Node(f"s{k}", 1.0, shard=k) for k in range(-(-shards // room) * room)]
    for level, width in (("k", per_rack), ("r", racks)):
        parts = [tuple(leaves[at : at + width]) for at in range(0, len(leaves), width)]
        leaves = [Node(f"{level}{k}", sum(x.weight for x in part), part) for k, part in enumerate(parts)]
    return tuple(leaves)


def draw(key: Column, node: Node) -> Column:
    """The node's draw for a key: an exponential variate of rate ``weight``; 52 bits of the hash make the uniform."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 12)
    return -F.log((bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))) / F.lit(node.weight)


def descend(key: Column, nodes: tuple[Node, ...]) -> Column:
    """The shard under ``nodes`` that ``key`` falls to. A null key is a key like any other."""
    if len(nodes) == 1:
        return F.lit(nodes[0].shard).cast("int") if nodes[0].shard is not None else descend(key, nodes[0].children)
    best = F.array_min(F.array(*[F.struct(draw(key, n).alias("draw"), F.lit(k).alias("at")) for k, n in enumerate(nodes)]))["at"]
    chosen = [F.lit(n.shard).cast("int") if n.shard is not None else descend(key, n.children) for n in nodes]
    out = F.when(best == 0, chosen[0])
    for k, c in enumerate(chosen[1:], 1):
        out = out.when(best == k, c)
    return out


def _filled(node: Node, shards: int) -> tuple[int, int]:
    """How many of a node's places are filled, and how many it has."""
    if node.shard is not None:
        return int(node.shard < shards), 1
    return tuple(map(sum, zip(*(_filled(c, shards) for c in node.children), strict=True)))


def _contenders(key: Column, nodes: tuple[Node, ...], drawn: list[Column], shards: int) -> list[tuple[Column, Column]]:
    """(draw, shard) of full subtrees and single places: the smallest draw of ``nodes`` is among theirs."""
    out = []
    for node, d in zip(nodes, drawn, strict=True):
        n, room = _filled(node, shards)
        if n == room:
            out.append((d, F.lit(node.shard).cast("int") if node.shard is not None else descend(key, node.children)))
        elif n:
            own = [draw(key, c) for c in node.children]
            low = F.least(*own) if len(own) > 1 else own[0]
            out += _contenders(key, node.children, [d + (x - low) for x in own], shards)
    return out


def place(key: Column, nodes: tuple[Node, ...], shards: int) -> Column:
    """The shard of ``key`` where the first ``shards`` places of the tree are filled. A null key is a key like any other."""
    found = _contenders(key, nodes, [draw(key, n) for n in nodes], shards)
    if len(found) == 1:
        return found[0][1]
    best = F.array_min(F.array(*[F.struct(d.alias("draw"), F.lit(k).alias("at")) for k, (d, _) in enumerate(found)]))["at"]
    out = F.when(best == 0, found[0][1])
    for k, (_, shard) in enumerate(found[1:], 1):
        out = out.when(best == k, shard)
    return out


def shard_rows(rows: DataFrame, key: str, shards: int, *, grown: bool = False) -> DataFrame:
    """``rows`` with ``shard`` (int), and ``grown_shard`` if asked: where the row would be with one more shard.

    Both depend on the key and the number of shards alone. Existing columns of these names are replaced.
    """
    out = rows.withColumn("shard", place(F.col(key), layout(shards), shards))
    return out.withColumn("grown_shard", place(F.col(key), layout(shards + 1), shards + 1)) if grown else out


def number_slots(rows: DataFrame, by: str, buckets: int) -> DataFrame:
    """``rows``, a stored table with a distinct ``_uid`` each, with ``slot``: 0, 1, ... without gaps inside each ``by``.

    A shard may hold any share of all rows, and so may a key or a text, so none is numbered in one task: rows are numbered
    inside ``buckets`` parts of a shard, dealt by ``_uid``, and a part begins where the counts of the parts before it end.
    """
    part = F.pmod(F.xxhash64("_uid"), F.lit(buckets)).cast("int")
    sizes = rows.groupBy(F.col(by).alias("_by"), part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_by").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over ``buckets`` counts
    begins = sizes.select("_by", F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    inside = F.row_number().over(Window.partitionBy(by, "_part").orderBy("_uid"))
    numbered = rows.withColumn("_part", part).withColumn("_row", inside.cast("long") - 1)
    return (
        numbered.join(F.broadcast(begins), (F.col(by) == F.col("_by")) & (F.col("_part") == F.col("_p")))  # shards x buckets rows
        .withColumn("slot", F.col("_row") + F.col("_begin"))
        .drop("_by", "_part", "_p", "_row", "_begin", "_uid")
    )


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs``.

    Null text counts as empty (size 1, crc 0); a null doc_id is one more key. Repeated rows each get a slot of their
    own, in one shard as the key decides. No rows give no rows. Other columns are left out.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        F.monotonically_increasing_id().alias("_uid"),
    )
    rows = stored(shard_rows(rows, "doc_id", shards, grown=True), "sharded")  # some twenty bytes a row; fixes _uid
    buckets = max(8, partitions(docs.sparkSession))
    return number_slots(rows, "shard", buckets).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op2_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(read_table(spark, sf_dir, "documents"))
