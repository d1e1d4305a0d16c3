"""Every query with SQL against DuckDB, the others for having rows at all."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, database

FOLDER = "/root/testdata/sf0.01"  # the smallest at which every query has rows


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", entry.queries())
def test_query(spark, con, name):
    assert compare(spark, con, FOLDER, entry.queries()[name], entry.oracle_sql().get(name)) == ""


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    assert df.count() == 150
