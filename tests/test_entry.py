"""Every query with an SQL equivalent gives the same rows as DuckDB on the smallest data set."""

import glob
import numbers
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from kinolex import plans

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(df):
    def cell(x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return "null"
        return str(round(float(x), 6) + 0.0) if isinstance(x, numbers.Number) and not isinstance(x, bool) else str(x)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, duck, name):
    got, expected = plans.QUERIES[name](spark, DATA).toPandas(), duck.execute(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_runs(spark, name):
    assert plans.QUERIES[name](spark, DATA).count() > 0


def test_contract(spark):
    assert entry.entry(spark).columns == ["profile_id", "item_id", "score", "rk"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
