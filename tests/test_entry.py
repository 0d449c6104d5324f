import os

import duckdb
import pytest

import __spark_entry__ as entry
from scorelane.queries import QUERIES, SQL


def values(df):
    cols = sorted(df.columns)
    return cols, sorted(map(tuple, df[cols].astype(object).where(df[cols].notna(), None).astype(str).values.tolist()))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for x in os.listdir("/root/testdata/sf0.001"):
        c.sql(f"create view {x.split('.')[0]} as select * from '/root/testdata/sf0.001/{x}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, data, duck, name):
    assert values(QUERIES[name](spark, data).toPandas()) == values(duck.sql(SQL[name]).df())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_queries_without_sql_run(spark, data):
    assert sum(r["n"] for r in QUERIES["index_build"](spark, data).collect()) == 1000
    status = {r["status"] for r in QUERIES["score_requests_ivf"](spark, data).collect()}
    assert status == {200, 400}
    assert set(SQL) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())
