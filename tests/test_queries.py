"""Every registered query against its checking SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_points
from siteferry.plans import registry
from tests.checking import compare, connect

SF_DIR = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
QUERIES = registry.queries()
ORACLES = registry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) is None


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
