"""Every registered query against its SQL on the smallest driver tables."""

import os

import compare
import pytest

import __spark_entry__ as entry
from quillrank import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = plans.load()

pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    rows = compare.rows_of_spark(QUERIES[name](spark, SF))
    assert name in ORACLES, "a query without an oracle needs a test of its own"
    assert compare.difference(rows, compare.rows_of_sql(con, ORACLES[name])) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_entry_names_all_queries():
    assert QUERIES.keys() <= entry.queries().keys()
    assert ORACLES.keys() <= entry.oracle_sql().keys()
