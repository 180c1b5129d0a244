"""Every query with SQL against DuckDB, at the smallest scale."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from weftline.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
SLOW = {"q44_stencil1d_loop", "q52_stencil_accum"}  # a hundred sweeps each; test_operators has shorter ones
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame) -> list[str]:
    cell = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("<NA>", "nan") else repr(round(float(v), 6)) if isinstance(v, int | float) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)
    return sorted(str([cell(v) for v in r]) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) - SLOW))
def test_same_rows_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
