"""Every query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries

from .oracle import TESTDATA, compare, connect

SF = str(TESTDATA / "sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    sql = oracle_sql().get(name)
    if sql is None:
        assert queries()[name](spark, SF).count() > 0
        return
    problem = compare(spark, con, queries()[name], sql, SF)
    assert problem in (None, "no rows"), problem


def test_entry(spark):
    assert entry(spark).columns == entry(spark).columns != []


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
