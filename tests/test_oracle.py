"""Every registered query against its SQL on the smallest data set."""

import pytest
from oracle import compare, connect

import __spark_entry__ as contract


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query_equals_sql(spark, con, sf, name):
    ok, text = compare(spark, con, name, sf)
    assert ok, text


def test_entry_runs(spark):
    df = contract.entry(spark)
    assert df.columns == ["region", "entity", "year", "peak"] and df.count() > 0


def test_sql_keys_are_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
