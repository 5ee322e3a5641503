"""Every registered query against its twin SQL at the smallest scale; queries without one must return rows."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
RUNS, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches_sql(spark, con, key):
    message, _, _ = compare(spark, con, key, RUNS[key], SQL[key], SF)
    assert not message, message


@pytest.mark.parametrize("key", sorted(set(RUNS) - set(SQL)))
def test_returns_rows(spark, key):
    assert not RUNS[key](spark, SF).isEmpty()


def test_flagship(spark):
    assert {r.risk for r in entry.entry(spark).collect()} <= {"water", "unknown", "very_high", "high", "moderate", "low"}
