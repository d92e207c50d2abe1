import pytest
from compare import assert_same, duck

from weftgraph.plans import catalog


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, sf, con, name):
    n = assert_same(catalog.QUERIES[name](spark, sf), con, catalog.ORACLES[name])
    assert n or name == "f_empty"


def test_every_query_has_sql():
    assert catalog.QUERIES.keys() == catalog.ORACLES.keys()
