"""Every query with SQL answers as DuckDB does, on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
CORE = [n for n in oracle_sql() if not n.startswith(("op", "pipeline"))]


def norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(repr(round(r[i], 6) + 0.0) if isinstance(r[i], float) else repr(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "lineitem", "events"):
        c.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    df = queries()[name](spark, SF)
    want = duck.sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry(spark).count() > 0
