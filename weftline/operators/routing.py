"""Distribution policies: which workers get an item, and how channels come together again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.nodes import BLOCK_ROWS, epochs, running


def round_robin(seq: Column | str, workers: int) -> Column:
    """Items go to workers 0, 1, ... in turn, by their place in the stream."""
    return F.pmod(F.col(seq) if isinstance(seq, str) else seq, F.lit(workers)).cast("int")


def by_key(key: Column | str, workers: int) -> Column:
    """Numbers go to key mod workers, other keys by hash."""
    return F.pmod(F.xxhash64(key), F.lit(workers)).cast("int")


def by_number(key: Column | str, workers: int) -> Column:
    return F.pmod(F.col(key) if isinstance(key, str) else key, F.lit(workers)).cast("int")


def route(df: DataFrame, worker: Column, workers: int) -> DataFrame:
    """``df`` with ``worker``, each worker's items in a partition of their own."""
    return df.withColumn("worker", worker).repartitionById(workers, F.col("worker"))


def broadcast_items(df: DataFrame, workers: int) -> DataFrame:
    """Every item once for each worker; nothing is shuffled."""
    return df.withColumn("worker", F.explode(F.sequence(F.lit(0), F.lit(workers - 1))))


def multicast(df: DataFrame, targets: Column) -> DataFrame:
    """Every item once for each worker in the array ``targets``."""
    return df.withColumn("worker", F.explode(targets))


def even_odd(df: DataFrame, value: str, order: str, evens: int, odds: int) -> DataFrame:
    """Even values round-robin over workers 0 to ``evens`` - 1, odd ones over the ``odds`` workers after those."""
    parity = F.pmod(F.col(value), F.lit(2))
    placed = running(df.withColumn("_parity", parity), "_parity", order, _place=F.lit(1).cast("long"))
    place = F.col("_place") - 1
    return placed.withColumn("worker", F.when(F.col("_parity") == 0, place % evens).otherwise(evens + place % odds).cast("int")).drop("_place", "_parity")


def scatter(df: DataFrame, index: str, total: int, lefts: int, rights: int) -> DataFrame:
    """Which of ``rights`` receivers owns an index (equal chunks), and which of ``lefts`` senders sends that chunk.

    Chunks are owned in runs: the first ``rights % lefts`` senders have one more than the others.
    """
    chunk = F.floor(F.col(index) / (total // rights)).cast("int")
    small, extra = divmod(rights, lefts)
    limit = extra * (small + 1)
    sender = F.when(F.col("right") < limit, F.floor(F.col("right") / (small + 1))).otherwise(extra + F.floor((F.col("right") - limit) / max(small, 1))).cast("int")
    return df.withColumn("right", chunk).withColumn("left", sender)


def gather_any(channels: list[DataFrame]) -> DataFrame:
    """All items of all channels, as a bag, with the ``channel`` that each came from."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [c.withColumn("channel", F.lit(k)) for k, c in enumerate(channels)])


def gather_all(df: DataFrame, channel: str, order: str, value: str, channels: int) -> DataFrame:
    """Positional zip: row k has the k-th item of every channel, null for channels that have ended, as an array by channel.

    Items are numbered in blocks of ``order``, so a channel is never numbered in one task.
    """
    numbered = running(df.select(F.col(channel).alias("_channel"), F.col(value).alias("_value"), F.col(order).alias("_order")), "_channel", "_order", seq=F.lit(1).cast("long"))
    placed = numbered.select("_channel", "_value", (F.col("seq") - 1).alias("seq"))
    cells = [F.max(F.when(F.col("_channel") == k, F.col("_value"))) for k in range(channels)]
    live = [F.count_if(F.col("_channel") == k) > 0 for k in range(channels)]
    return placed.groupBy("seq").agg(F.array(*cells).alias("items"), sum((x.cast("int") for x in live[1:]), live[0].cast("int")).alias("live"))


def managed(df: DataFrame, control: DataFrame, order: str, value: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``control``: the value that the manager's channel, rows of (order, value), sent last before the item; null before its first.

    Messages are counted along the stream in blocks, and the item's count names its message: an equi-join of epochs.
    """
    sent = control.select(F.col(order).alias("_at"), F.lit(True).alias("_sent"), F.col(value).alias("_value"))
    items = df.select(F.col(order).alias("_at"), F.lit(False).alias("_sent"), F.struct(*df.columns).alias("_item"))
    both = items.unionByName(sent, allowMissingColumns=True).withColumn("_turn", 2 * F.col("_at") + F.when(F.col("_sent"), 0).otherwise(1))
    counted = epochs(both, F.col("_sent"), "_turn", rows)
    messages = counted.where("_sent").select((F.col("epoch") + 1).alias("_epoch"), F.col("_value").alias("control"))
    out = counted.where(~F.col("_sent")).join(messages, F.col("epoch") == F.col("_epoch"), "left")
    return out.select("_item.*", "control")


def ordered(df: DataFrame, seq: str = "seq") -> DataFrame:
    """The farm's output in the order of its input: a range-partitioned sort, so no task sees it all."""
    return df.orderBy(seq)
