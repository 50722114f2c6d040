"""Every registered query against its SQL; queries without SQL against brute force elsewhere."""

import pytest

import __spark_entry__ as entry
from oracle import duck, duck_rows, spark_rows
from tidemark.plans.catalog import QUERIES
from tidemark.plans.oracles import ORACLES


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, con, name):
    columns, rows = spark_rows(entry.queries()[name](spark, sf))
    want_columns, want = duck_rows(con, ORACLES[name])
    assert columns == want_columns
    assert rows == want
