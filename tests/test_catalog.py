"""Every registered query against its SQL on the smallest tables; row checks for the others."""

import pytest

import __spark_entry__ as entry
from tests.compare import difference, duck

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, con, name):
    assert difference(QUERIES[name](spark, sf).toPandas(), con.execute(SQL[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_returns_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_is_stable(spark):
    first = entry.entry(spark)
    assert first.count() == 1000
    assert first.schema == entry.entry(spark).schema


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
