"""Word count over lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import cut_word, space_tokens
from weftline.operators.nodes import even_blocks
from weftline.sources.readers import text_lines


#: Fixed value: bytes that a line takes in the stream, whatever its length.
LINE_BYTES = 152
#: Bytes of text whose words one task sorts: some 2.5 million words of 130 bytes.
BLOCK_BYTES = 16 << 20


def words(docs: DataFrame, text: str = "text", key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carried columns, line, pos, word): the words of all non-empty lines, cut to the greatest length of a word."""
    lines = text_lines(docs, text, key, carry=carry)
    return lines.select("key", *carry, "line", F.posexplode(space_tokens("text_line")).alias("pos", "word")).withColumn("word", cut_word("word"))


def totals(docs: DataFrame) -> DataFrame:
    """(word, cnt): partial counts are combined before the shuffle."""
    tokens = F.flatten(F.transform(F.split("text", "\n"), lambda line: space_tokens(line)))
    return docs.select(F.explode(tokens).alias("word")).groupBy(cut_word("word").alias("word")).agg(F.count("*").alias("cnt"))


def running(docs: DataFrame, block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, line, pos, word, id): the running count of every word, in the order of the text, with what lines ``carry``
    (a time stamp, say).

    Texts are shuffled, not words: each block, a range of documents with about ``block_bytes`` of text, is one task, which
    splits its texts. A first pass counts a block's words; how often a word occurs in the blocks before one is sent to it
    as a text of that one word, and comes first when the block's words are numbered. A word may be a large share of all.
    """
    held = docs.select(F.col("doc_id").alias("key"), *carry, "text")
    block, blocks = even_blocks(held, "key", F.octet_length("text"), block_bytes)
    placed = held.withColumn("_block", block)
    counts = words(placed.repartitionById(blocks, F.col("_block")), key="key", carry=("_block",)).groupBy("_block", "word").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("word").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("_block", F.col("word").alias("text"), F.sum("_n").over(before).alias("_begin")).where("_begin > 0")
    both = placed.withColumn("_begin", F.lit(None).cast("long")).unionByName(begins, allowMissingColumns=True).repartitionById(blocks, F.col("_block"))
    group = Window.partitionBy("word", "_block").orderBy(F.desc_nulls_last("_begin"), F.asc_nulls_last("key"), "line", "pos")
    so_far = F.sum(F.coalesce("_begin", F.lit(1))).over(group.rowsBetween(Window.unboundedPreceding, 0))
    numbered = words(both, key="key", carry=(*carry, "_block", "_begin")).withColumn("id", so_far).where("_begin IS NULL")
    return numbered.select(F.col("key").alias("doc_id"), "line", "pos", "word", *carry, "id")


def summary(docs: DataFrame) -> DataFrame:
    """One row: words, unique (different words), total_lines and total_bytes (of lines as the stream holds them)."""
    lines = text_lines(docs, "text", "doc_id")
    counted = totals(docs).agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("words"), F.count("*").alias("unique"))
    return counted.crossJoin(F.broadcast(lines.agg(F.count("*").alias("total_lines"), (F.count("*") * LINE_BYTES).alias("total_bytes"))))
