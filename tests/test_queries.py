"""Every query with SQL against DuckDB on the smallest tables, where these are at hand."""

import os

import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = os.environ.get("PRESSMILL_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")


def plain(frame):
    frame = frame[sorted(frame.columns)]

    def one(v):
        if pd.isna(v):
            return "null"
        if hasattr(v, "item"):
            v = v.item()
        return repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else repr(v)

    return list(frame.columns), sorted(tuple(map(one, row)) for row in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for name in os.listdir(TABLES):
        con.execute(f"create view {name.split('.')[0]} as select * from '{TABLES}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    assert plain(entry.queries()[name](spark, TABLES).toPandas()) == plain(duck.execute(entry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, name):
    assert entry.queries()[name](spark, TABLES).count() > 0


def test_entry(spark):
    assert entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
