"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as entry_point
from rollspark.plans.catalog import QUERIES as REGISTERED

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")

QUERIES = {name: q.run for name, q in REGISTERED.items()}
SQL = {name: q.sql for name, q in REGISTERED.items()}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    assert compare(QUERIES[name](spark, SF_DIR), con, SQL[name]) is None


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_all_queries_have_sql():
    assert None not in SQL.values()
    assert set(QUERIES) <= set(entry_point.queries()) and set(SQL) <= set(entry_point.oracle_sql())
