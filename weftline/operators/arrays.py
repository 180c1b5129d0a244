"""Data parallelism inside one item: maps and reductions over array columns, and a shared environment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_array(values: Column | str, body: Callable[[Column], Column]) -> Column:
    return F.transform(values, body)


def map_arrays(a: Column | str, b: Column | str, body: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(a, b, body)


def reduce_array(values: Column | str, identity: Column, combine: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(values, identity, combine)


def with_environment(df: DataFrame, env: DataFrame, on: str, env_key: str, most_rows: int = 1_000_000) -> DataFrame:
    """``df`` with the columns of the read-only side array ``env``, by key. It is broadcast up to ``most_rows`` rows only."""
    small = env.limit(most_rows + 1).count() <= most_rows
    return df.join(F.broadcast(env) if small else env, df[on] == env[env_key], "left").drop(env[env_key])
