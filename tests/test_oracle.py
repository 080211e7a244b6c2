"""Every catalogue query with an oracle equals DuckDB on the same tables (sf0.01)."""

import pytest

import __spark_entry__ as E
from conftest import SF01
from oracle import compare

KEYS = sorted(E.oracle_sql())


@pytest.mark.parametrize("key", KEYS)
def test_matches_duckdb(spark, key):
    ok, msg = compare(spark, key, SF01, E.queries()[key], E.oracle_sql()[key])
    assert ok, msg


def test_entry_runs(spark):
    df = E.entry(spark)
    assert set(["row_id", "phase", "reason"]) <= set(df.columns)
    assert df.count() >= 0


def test_every_query_has_a_callable():
    assert set(E.oracle_sql()) <= set(E.queries())
