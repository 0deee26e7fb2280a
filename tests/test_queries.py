import pytest

import __spark_entry__ as entry
from helixframe.plans import registry
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, sf, name):
    if name in registry.ORACLES:
        got, want = compare(spark, con, registry.QUERIES[name], registry.ORACLES[name], sf)
        assert got[0] == want[0]
        assert got[1] == want[1]
    else:
        registry.QUERIES[name](spark, sf).collect()


def test_driver_contract(spark):
    assert entry.entry(spark).columns == ["length", "seq"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())
