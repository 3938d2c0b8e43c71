import pytest
from oracle import compare, connect

from folioforge.jobs import catalogue, catalogue_sql, contract_catalogue, library_catalogue, notes_catalogue, records_catalogue, retrieval_catalogue  # noqa: F401

QUERIES = catalogue.queries() | notes_catalogue.Q
SQL = catalogue_sql.SQL | notes_catalogue.SQL


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, con, sf, name):
    compare(spark, con, QUERIES[name], SQL[name], sf)


def test_every_query_runs(spark, sf):
    for name in sorted(set(QUERIES) - set(SQL)):
        assert QUERIES[name](spark, sf).count() >= 1, name
