"""Loops over DataFrames: feedback, graph search, divide and conquer, pools. Each step is cut from its lineage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed and kept in the checkpoint folder that the session names; its lineage ends there."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only on one machine a temporary folder may take its place."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder and context.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder or f"file://{tempfile.mkdtemp(prefix='weftline-')}"


def feedback(seeds: DataFrame, body: Callable[[DataFrame], DataFrame], most_rounds: int = 10_000, distinct: list[str] | None = None) -> DataFrame:
    """All items that pass the head of a loop: the seeds, and what ``body`` sends back, until nothing is sent back.

    With ``distinct`` an item passes once for each value of those columns, which ends loops over cyclic data; without it
    items are a bag. ``body`` gets the items of one round. Rounds are counted on the driver, items stay where they are.
    """
    if distinct:
        seeds = seeds.dropDuplicates(distinct)
    front = cut(seeds)
    done = [front]
    for _ in range(most_rounds):
        new = body(front).select(*front.columns)
        if distinct:
            new = new.dropDuplicates(distinct).join(_union(done).select(*distinct), distinct, "left_anti").select(*front.columns)
        front = cut(new)
        if front.isEmpty():
            return _union(done)
        done = _append(done, front)
    raise RuntimeError("the loop did not end")


def _append(parts: list[DataFrame], new: DataFrame, most: int = 16) -> list[DataFrame]:
    """``parts`` and one more. What earlier rounds found is not written again, but for once in ``most`` rounds, when the
    parts become one, as a long chain of unions slows planning."""
    parts = [*parts, new]
    return [cut(_union(parts))] if len(parts) > most else parts


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def search_graph(vertices: DataFrame, edges: DataFrame, start: int, target: object, first_only: bool = False) -> DataFrame:
    """(id): vertices reachable from ``start``, itself included, whose element is ``target``.

    With ``first_only`` the search ends in the round of the first match and gives that match with the smallest id. Every
    vertex is expanded once. Edges are dealt out by their source once, and rounds join them where they are.
    """
    spark = vertices.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = cut(edges.select(F.col("src").cast("long").alias("id"), F.col("dst").cast("long").alias("dst")).repartition(parts, "id"))
    front = cut(spark.range(1).select(F.lit(start).cast("long").alias("id")).join(vertices.select(F.col("id").cast("long")), "id"))
    seen = [front]
    matches = vertices.where(F.col("elem") == F.lit(target)).select(F.col("id").cast("long").alias("id"))
    while not front.isEmpty():
        if first_only:
            hit = front.join(matches, "id").agg(F.min("id").alias("id")).where("id IS NOT NULL")
            if not hit.isEmpty():
                return hit
        step = links.join(front, "id").select(F.col("dst").alias("id")).distinct()
        front = cut(step.join(_union(seen), "id", "left_anti"))
        seen = _append(seen, front)
    found = _union(seen).join(matches, "id")
    return found.limit(0) if first_only else found


def divide_and_conquer(ops: DataFrame, is_base: Column, divide: Column, solve: Column, combine: Callable[[Column], Column], most_levels: int = 500) -> DataFrame:
    """(op, result): one result for each row of ``ops`` (column ``op``).

    Level by level an operand that is no base case becomes the array of operands ``divide``, until all are base cases,
    which ``solve`` solves; on the way back ``combine`` gets a parent's results as an array in the order of its parts.
    Equal operands are worked on once, whoever needs them.
    """
    level = cut(ops.select("op").distinct())
    known = level
    parts: list[DataFrame] = []
    bases = []
    for _ in range(most_levels):
        bases.append(level.where(is_base))
        split = cut(level.where(~is_base).select("op", F.posexplode(divide).alias("k", "sub")))
        if split.isEmpty():
            break
        parts.append(split)
        fresh = split.select(F.col("sub").alias("op")).distinct().join(known, "op", "left_anti")
        level = cut(fresh)
        known = cut(known.unionByName(level))
    else:
        raise RuntimeError("an operand never became a base case")
    done = cut(_union(bases).select("op", solve.alias("result")))
    waiting = parts and cut(_union(parts))
    while waiting:
        ready = waiting.join(done.withColumnRenamed("op", "sub"), "sub", "left")
        solved = ready.groupBy("op").agg(F.count_if(F.col("result").isNull()).alias("open"), F.transform(F.array_sort(F.collect_list(F.struct("k", "result"))), lambda s: s["result"]).alias("results")).where("open = 0")
        solved = cut(solved.select("op", combine(F.col("results")).alias("result")))
        if solved.isEmpty():
            break
        done = cut(done.unionByName(solved))
        waiting = cut(waiting.join(solved.select("op"), "op", "left_anti"))
    return ops.join(done, "op").select("op", "result")


def evolve_pool(pool: DataFrame, env: dict, select: Callable, evolve: Callable, filter_: Callable, stop: Callable, most_rounds: int = 1000) -> tuple[DataFrame, dict]:
    """``while not stop: pool = filter(pool, evolve(select(pool)))`` with an environment beside the population.

    ``select(pool, env)`` and ``filter_(pool, evolved, env)`` give (DataFrame, env), ``stop(pool, env)`` gives (bool, env);
    ``evolve(df, env)`` only reads the environment. The new population is what ``filter_`` returns.
    """
    pool = cut(pool)
    for _ in range(most_rounds):
        over, env = stop(pool, env)
        if over:
            return pool, env
        chosen, env = select(pool, env)
        pool, env = filter_(pool, evolve(chosen, env), env)
        pool = cut(pool)
    return pool, env


def fixed_grid(spark: SparkSession, rows: int, cols: int, value: str) -> DataFrame:
    """(i, j, v) of a ``rows`` by ``cols`` grid, ``value`` being SQL over i and j."""
    cells = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("i"), (F.col("id") % cols).cast("int").alias("j"))
    return cells.withColumn("v", F.expr(value))
