"""Every registered query against its SQL counterpart."""

import pytest

import __spark_entry__ as entry_module
from compare import connect, difference
from heliograph.plans.oracle import ORACLE_SQL
from heliograph.plans.registry import QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert QUERIES.items() <= entry_module.queries().items()
    assert ORACLE_SQL.items() <= entry_module.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    assert difference(df, con, ORACLE_SQL[name]) is None


def test_entry(spark, sf):
    assert entry_module.entry(spark).count() > 0
