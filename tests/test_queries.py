"""Every registered query against its SQL, over whole tables at the smallest scale."""

import pytest

import __spark_entry__ as entry
from qanat.plans import all_queries
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"
ORACLES = all_queries.ORACLES
QUERIES = {name: entry.queries()[name] for name in all_queries.QUERIES}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 150 and rows[0]["refreshed_at"] is not None
