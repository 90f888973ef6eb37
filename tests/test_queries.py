"""Every query with checking SQL, on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry
from check_queries import compare, connect

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_sql(spark, con, key):
    message = compare(entry.queries()[key](spark, FOLDER), con, SQL[key])
    assert message == "" or (message == "EMPTY" and key in MAY_BE_EMPTY), message


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "is_aggregated" in df.columns
