"""Every registered query runs on sf0.001; SQL-expressible ones equal their DuckDB oracle."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import table_hash  # noqa: E402
from sievekit.sources.tables import TABLES  # noqa: E402

SF = "/root/testdata/sf0.001"
SLOW = {"batch_score", "runtime_metrics"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["lang", "documents", "documents_hit", "hits", "share_hit"]
    assert df.count() == 4


@pytest.mark.parametrize("key", sorted(set(E.queries()) - SLOW))
def test_query_matches_oracle(spark, duck, key):
    df = E.queries()[key](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    sql = E.oracle_sql().get(key)
    if sql is None:
        return
    res = duck.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(rows) == len(drows)
    assert table_hash(df.columns, rows)[0] == table_hash(dcols, drows)[0]
