"""Guards: time zone, required parameters, case duplicates, stray ids, repeated map rows, pinned prices."""

import hashlib
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from helpers import intervals_df
from idlecost import TcoParams
from idlecost import operators as op
from idlecost.plans import CustomerAnalysis, RegionAnalysis
from idlecost.sources import load_inputs
from idlecost.sources import price_book as pb
from idlecost.sources.fixtures import CUSTOMER_PARAMS, REGION_PARAMS, load_fixture_inputs


def test_session_time_zone_must_be_utc(spark):
    inputs = load_fixture_inputs(spark, SF_SMALL)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for kind, params in ((CustomerAnalysis, CUSTOMER_PARAMS), (RegionAnalysis, REGION_PARAMS)):
            with pytest.raises(ValueError, match="UTC"):
                kind(inputs, params)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_parameters_of_the_entry_are_required(spark):
    inputs = load_fixture_inputs(spark, SF_SMALL)
    bare = TcoParams(start_date="2024-01-01", end_date="2024-01-30")
    with pytest.raises(ValueError, match="customer_name, lifecycle_metric, create_actions"):
        CustomerAnalysis(inputs, bare)
    with pytest.raises(ValueError, match="sales_region"):
        RegionAnalysis(inputs, bare)


def test_a_query_opens_only_its_tables(spark):
    inputs = load_fixture_inputs(spark, SF_SMALL)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup
    before = len(jobs())
    CustomerAnalysis(inputs, CUSTOMER_PARAMS).intervals
    assert list(inputs.opened) == ["statements"] and len(jobs()) == before  # no job infers a schema
    CustomerAnalysis(inputs, CUSTOMER_PARAMS).non_serverless_clusters
    assert set(inputs.opened) == {"statements", "cluster_events"}


def test_a_run_needs_the_tables_it_reads(spark, tmp_path):
    fixture = load_fixture_inputs(spark, SF_SMALL)
    names = ["statements", "endpoints", "cluster_events", "workspaces", "workloads"]
    for name in names:
        getattr(fixture, name).write.parquet(f"{tmp_path}/{name}")
    inputs = load_inputs(spark, {n: f"{tmp_path}/{n}" for n in names})
    run = CustomerAnalysis(inputs, CUSTOMER_PARAMS)
    want = sorted(map(tuple, CustomerAnalysis(fixture, CUSTOMER_PARAMS).grand_totals().collect()))
    assert sorted(map(tuple, run.grand_totals().collect())) == want and "billing" not in inputs.opened
    with pytest.raises(ValueError, match="reads 'billing'"):
        RegionAnalysis(inputs, REGION_PARAMS).top_accounts
    with pytest.raises(ValueError, match="unknown input"):
        load_inputs(spark, {"statement": f"{tmp_path}/statements"})


def test_string_ids_and_single_schemas(spark, tmp_path):
    """Ids of another type are told once; a file whose types differ brings its own schema."""
    fixture = load_fixture_inputs(spark, SF_SMALL)
    ids = ["statement_id", "cluster_id", "workspace_id", "endpoint_id"]
    for name in ("statements", "endpoints", "cluster_events", "workspaces"):
        df = getattr(fixture, name)
        df.withColumns({c: F.concat(F.lit("0"), F.col(c).cast("string")) for c in ids if c in df.columns}).write.parquet(f"{tmp_path}/{name}")
    inputs = load_inputs(spark, {n: f"{tmp_path}/{n}" for n in ("statements", "endpoints", "workspaces")}, id_type="string",
                         schemas={"statements": None})
    assert inputs.id_type == "string" and inputs.endpoints.schema["cluster_id"].dataType.simpleString() == "string"
    assert inputs.statements.schema["fetch_s"].dataType.simpleString() == "int"
    run = CustomerAnalysis(inputs, CUSTOMER_PARAMS)
    assert run.intervals.join(run.customer_clusters, "cluster_id").count() > 0


def test_entry_survives_a_missing_optional_module():
    code = ("import sys; sys.modules['tiktoken'] = None; sys.modules['tokenizers'] = None; import __spark_entry__ as se; "
            "q = se.queries(); print(len(q), 'cost_comparison' in q, set(se.oracle_sql()) <= set(q))")
    root = Path(__file__).resolve().parents[1]
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and out.stdout.endswith("True True\n"), out.stderr


def test_billing_range_follows_the_run(spark):
    p = TcoParams(start_date="2024-01-01", end_date="2024-01-30", sales_region="EMEA", top_accounts=20, only_finished=False)
    assert (p.billing_start_date, p.billing_end_date) == (p.start_date, p.end_date)
    assert REGION_PARAMS.billing_start_date.year == 1995
    RegionAnalysis(load_fixture_inputs(spark, SF_SMALL), p)


def test_accounts_spelled_in_two_ways_count_once(spark):
    ws = spark.createDataFrame([(1, "ACME"), (2, "other")], "workspace_id long, customer_name string")
    accounts = spark.createDataFrame([("Acme", 1.0), ("acme", 2.0)], "account_name string, total_dbus double")
    assert [tuple(r) for r in op.account_workspaces(ws, accounts).collect()] == [(1, "ACME")]
    endpoints = spark.createDataFrame([(5, 1, 9), (5, 1, 9)], "cluster_id long, workspace_id long, endpoint_id long")
    assert op.account_clusters(endpoints, op.account_workspaces(ws, accounts)).count() == 1


def test_stray_cluster_ids_do_not_stop_the_run(spark):
    rows = [("2024-01-02", "life", {"action": "new", "cluster_id": c}) for c in ("0110-ab12", "17", None)]
    log = spark.createDataFrame(rows, "date string, metric string, tags map<string,string>").withColumn("date", F.to_date("date"))
    p = TcoParams(start_date="2024-01-01", end_date="2024-01-30")
    args = (log, p.start_date, p.end_date, "life", ("new",))
    assert {r[0] for r in op.non_serverless_clusters(*args).collect()} == {"0110-ab12", "17"}
    assert {r[0] for r in op.non_serverless_clusters(*args, "bigint").collect()} == {17}


def test_absurd_intervals_fail_with_a_message(spark):
    with pytest.raises(Exception, match="spans more than"):
        op.day_slices(intervals_df(spark, [(1, 0, 4000 * 86_400)])).collect()
    assert op.day_slices(intervals_df(spark, [(1, 100, 50)])).collect() == []


def test_prices_are_pinned():
    """All 163 prices by one digest, so that a change of the book can't go unnoticed."""
    rows = [(b, *r) for b in sorted(pb.BOOKS) for r in pb.vm_price_wide_rows(b)] + [("dbu", *r) for r in pb.ON_DEMAND_DBU_USD]
    prices = sum(x is not None for r in rows if r[0] != "dbu" for x in r[3:]) + len(pb.ON_DEMAND_DBU_USD)
    said = "\n".join(repr(r) for r in sorted(rows, key=repr))
    assert (prices, hashlib.sha256(said.encode()).hexdigest()) == PINNED


PINNED = (163, "11dd3437528f1c77d3a339977973c5c962778fd53fba1efcb9cd8b56f62db315")
