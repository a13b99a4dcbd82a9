"""Every registered query against its DuckDB oracle at sf0.01 (rows-only where no SQL is given)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF01, SF001
from tests.oracle import compare, duck

QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[0] == "customer_id"
    assert E.entry(spark).schema == df.schema  # stable schema


def test_every_query_has_oracle_or_is_rows_only():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF01)
    if name not in ORACLE:
        assert df.count() >= 0
        return
    ok, info = compare(df, con, ORACLE[name])
    assert ok, info


@pytest.mark.parametrize("name", ["customer_360", "profile_orders", "qc_orders", "pii_scan_customer"])
def test_smoke_scale(spark, name):
    con = duck(SF001)
    ok, info = compare(QUERIES[name](spark, SF001), con, ORACLE[name])
    assert ok, info
