import pytest

from pagemill.plans import catalogue, catalogue_files, catalogue_more  # noqa: F401  register their queries
from tests.oracle import agree, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_agrees_with_its_sql(spark, con, sf, name):
    agree(spark, con, catalogue.QUERIES[name], catalogue.SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0
