"""Every query against its SQL in DuckDB, at the smallest scale."""

import pytest
from compare import connect, differences

from __spark_entry__ import entry, oracle_sql, queries
from workload import business, governed, requested

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


OWN = {name: sql for part in (business, governed, requested) for name, sql in part.ORACLES.items()}


def test_every_query_has_its_sql():
    assert set(OWN) == {n for part in (business, governed, requested) for n in part.QUERIES}
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", list(OWN))
def test_query_equals_sql(spark, con, name):
    assert differences(queries()[name](spark, SF), con, OWN[name]) is None
