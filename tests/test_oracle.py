"""Every query with a DuckDB equivalent agrees with it on the small tables."""

import pytest

from workloads import check, oracle, registry


@pytest.fixture(scope="module")
def con(sf):
    return check.connect(sf)


def test_every_oracle_belongs_to_a_query():
    assert set(oracle.oracle_sql()) <= set(registry.registry())
    assert set(registry.registry()) == set(oracle.oracle_sql())


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query(spark, sf, con, name):
    result = check.compare(spark, con, name, sf)
    assert result.startswith("ok"), result
