"""Every query that has SQL gives the same rows as DuckDB, over the supplied tables."""

import oracle
import pytest

from callscope.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connection(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf_dir, con, name):
    assert oracle.difference(con, QUERIES[name](spark, sf_dir), SQL[name]) == ""


def test_every_sql_has_a_query():
    assert not set(SQL) - set(QUERIES)
