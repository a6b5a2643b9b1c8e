"""The subpackage's queries against their SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tests.test_queries import rows
from veritrove.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, data, duck, name):
    got, want = QUERIES[name](spark, data).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_run(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0
