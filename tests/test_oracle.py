"""Every registered query against its DuckDB statement, row for row (sf0.001)."""

import pytest

from conftest import SF_SMALL
from tools.check_oracle import compare, duck

import __spark_entry__ as se

KEYS = sorted(se._Q)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_oracle_sql():
    assert set(KEYS) <= set(se.oracle_sql()) <= set(se.queries())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    r = compare(spark, con, key, se.queries()[key], se.oracle_sql()[key], SF_SMALL)
    assert r["status"] == "ok", r


def test_entry_runs(spark):
    df = se.entry(spark)
    rows = df.collect()
    assert df.columns == ["customer_name", "on_demand_usd", "always_on_usd", "dbu_usd", "vm_usd",
                          "team_variation_usd", "variation_usd", "variation_pct"]
    assert len(rows) >= 1


@pytest.mark.parametrize("key", ["idle_sessions_global", "vm_cost_region", "cost_comparison", "grand_totals"])
def test_results_do_not_depend_on_physical_strategy(spark, con, key):
    """AQE off and automatic broadcasts off (sort-merge joins): same rows as the oracle."""
    saved = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        r = compare(spark, con, key, se.queries()[key], se.oracle_sql()[key], SF_SMALL)
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    assert r["status"] == "ok", r
