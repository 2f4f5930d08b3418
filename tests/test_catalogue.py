"""Every query's values and tags against DuckDB."""

import os

import pytest
from oracle import connect, rows_of_duckdb, rows_of_spark

from provenant import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_equals_duckdb(spark, duck, name):
    assert rows_of_spark(catalogue.QUERIES[name](spark, SF)) == rows_of_duckdb(duck, catalogue.ORACLE_SQL[name])
