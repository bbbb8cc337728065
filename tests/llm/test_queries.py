"""The llm queries against their SQL in DuckDB, and all of them on the smallest data set."""

import pytest

from kinolex import llm
from tests.test_entry import DATA, duck, rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    got, expected = llm.QUERIES[name](spark, DATA).toPandas(), duck.execute(llm.SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(llm.QUERIES) - set(llm.SQL)))
def test_query_runs(spark, name):
    got = llm.QUERIES[name](spark, DATA.replace("0.001", "0.01")).toPandas()
    assert len(got) and not got.duplicated().any()
