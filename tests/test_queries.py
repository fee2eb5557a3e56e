"""Every registered query with SQL gives the same rows as DuckDB on the small tables."""

import pytest

from __spark_entry__ import oracle_sql, queries
from tests.check import compare, connect

SQL = oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, folder, name):
    ok, info = compare(spark, con, name, queries()[name], SQL[name], folder)
    assert ok, info


def test_every_sql_has_a_query():
    assert set(SQL) <= set(queries())


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() == 3
