import pytest

from __spark_entry__ import entry, oracle_sql, queries
from sinogrid.plans import oracles, registry
from tests.compare import check, connect


OWN = registry.all_queries()


def test_every_query_has_sql():
    assert set(oracles.all_oracles()) == set(OWN)
    assert set(OWN) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(OWN))
def test_query_equals_sql(spark, data, con, name):
    problem = check(OWN[name](spark, data), con, oracles.all_oracles()[name])
    assert problem is None, problem


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1
