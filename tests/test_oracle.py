"""Every registered query against its SQL form on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect
from tablewright.plans import queries as own

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(data_dir):
    return connect(data_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, data_dir, name):
    _, problem = compare(spark, con, data_dir, QUERIES[name], SQL.get(name))
    assert problem is None


def test_every_query_has_sql():
    assert set(own.ORACLES) == set(own.QUERIES)


def test_entry_rows(spark):
    assert entry.entry(spark).count() == 11
