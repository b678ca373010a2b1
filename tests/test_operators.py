
import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helpers import T0, US, intervals_df
from idlecost import operators as op
from idlecost.functions.time import MICROS_PER_DAY
from idlecost.sources import price_book as pb

HOUR = 3600


def _sessions(spark, rows, gap_s, scope="cluster", bucket_s=900):
    df = intervals_df(spark, rows)
    out = op.idle_sessions(df, gap_s, scope, group_by=["cluster_id"], bucket_s=bucket_s)
    return sorted((r.cluster_id, (r.start_us - T0) / US, (r.end_us - T0) / US, r.statements) for r in out.collect())


def test_sessions_gap_exactly_auto_stop_merges(spark):
    got = _sessions(spark, [(1, 0, 5), (1, 15, 20), (1, 30.001, 35)], 10)
    assert got == [(1, 0.0, 20.0, 2), (1, 30.001, 35.0, 1)]


@pytest.mark.parametrize("bucket_s", [1, 7, 900, 86400])
def test_sessions_do_not_depend_on_bucket(spark, bucket_s):
    rows = [(1, 0, 5), (1, 15, 20), (1, 30.001, 35), (1, 36, 36), (2, 3, 4), (2, 100, 400), (2, 405, 406)]
    assert _sessions(spark, rows, 10, bucket_s=bucket_s) == _sessions(spark, rows, 10, bucket_s=900)


def test_sessions_cluster_versus_global_scope(spark):
    rows = [(1, 0, 5), (2, 12, 14), (1, 22, 23)]
    # cluster scope: cluster 1 is idle 17 s > 10 s, so it stops
    assert _sessions(spark, rows, 10, "cluster") == [(1, 0.0, 5.0, 1), (1, 22.0, 23.0, 1), (2, 12.0, 14.0, 1)]
    # global scope: cluster 2's statement bridges the gap (the original notebooks' behaviour)
    assert _sessions(spark, rows, 10, "global") == [(1, 0.0, 23.0, 2), (2, 12.0, 14.0, 1)]


def test_session_autostop_tail_and_date(spark):
    df = intervals_df(spark, [(1, 10.7, 20.9)])
    r = op.idle_sessions(df, 60, group_by=["cluster_id"]).collect()[0]
    assert r.end_autostop_us == T0 + (20 + 60) * US  # end floored to the second, plus auto-stop
    assert r.date == dt.date(2024, 1, 10)


def test_day_slices_multi_day(spark):
    df = intervals_df(spark, [(1, 15 * HOUR, 2 * 86400 + 10 * HOUR)])
    got = sorted((r.date, (r.end_us - r.start_us) / US / HOUR) for r in op.day_slices(df).collect())
    assert got == [(dt.date(2024, 1, 10), 9.0), (dt.date(2024, 1, 11), 24.0), (dt.date(2024, 1, 12), 10.0)]


def test_day_slices_end_at_midnight_has_no_empty_piece(spark):
    df = intervals_df(spark, [(1, 20 * HOUR, 86400), (2, 5, 5)])
    got = sorted((r.cluster_id, r.date, r.start_us, r.end_us) for r in op.day_slices(df).collect())
    assert got == [(1, dt.date(2024, 1, 10), T0 + 20 * HOUR * US, T0 + MICROS_PER_DAY),
                   (2, dt.date(2024, 1, 10), T0 + 5 * US, T0 + 5 * US)]


DAILY = T.StructType([
    T.StructField("driver_node_type", T.StringType()), T.StructField("worker_node_type", T.StringType()),
    T.StructField("max_workers", T.LongType()), T.StructField("region", T.StringType()),
    T.StructField("is_spot", T.BooleanType()), T.StructField("node_hours", T.DoubleType()),
    T.StructField("dbu_usd", T.DoubleType()), T.StructField("max_pricing_units", T.LongType()),
])


def _vm(spark, rows, discount=0, book="customer"):
    df = spark.createDataFrame(rows, DAILY)
    f = op.vm_cost if book == "customer" else op.vm_cost_region
    return f(df, discount).collect()


def test_vm_cost_on_demand_and_spot(spark):
    r = _vm(spark, [("i3.8xlarge", "i3.2xlarge", 4, "us-east-1", False, 1.0, 0.0, 1),
                    ("i3.8xlarge", "i3.2xlarge", 4, "us-east-1", True, 1.0, 0.0, 1)])
    by_spot = {x.is_spot: x for x in r}
    assert by_spot[False].vm_on_demand_usd == pytest.approx(4.992)
    assert by_spot[False].vm_spot_usd == 0.0
    assert by_spot[True].vm_spot_usd == pytest.approx(1.82208)
    assert by_spot[True].vm_on_demand_usd == 0.0


def test_vm_cost_fallbacks(spark):
    rows = [
        ("i3.8xlarge", "i3.2xlarge", None, None, None, 2.0, 1.0, 1),         # null region, workers, spot
        ("i3.8xlarge", "i3.2xlarge", 1, "sa-east-1", False, 1.0, 1.0, 1),    # region not in the book
        ("m9.large", "i3.4xlarge", 2, "us-west-2", False, 1.0, 1.0, 1),      # unknown driver: default pair
        ("Standard_D99", "Standard_E8ds_v4", 1, "westeurope", False, 1.0, 1.0, 1),
        ("i3.4xlarge", "x9.huge", 3, "eu-west-1", False, 1.0, 1.0, 1),       # unknown worker: default worker
    ]
    r = _vm(spark, rows, discount=10)
    got = [x.vm_on_demand_usd for x in r]
    assert got[0] == pytest.approx((2.496 * 0.9 + 0.624 * 0.9 * 1) * 2.0)
    assert got[1] == pytest.approx(2.496 * 0.9 + 0.624 * 0.9)
    assert got[2] == pytest.approx(2.496 * 0.9 + 0.624 * 0.9 * 2)
    assert got[3] == pytest.approx(2.768 * 0.9 + 0.692 * 0.9)
    assert got[4] == pytest.approx(1.376 * 0.9 + 0.688 * 0.9 * 3)
    assert all(x.total_usd == pytest.approx(x.vm_on_demand_usd + 1.0) for x in r)


def test_vm_cost_region_book_knows_v3(spark):
    rows = [("Standard_E8_v3", "Standard_E8ds_v4", 1, "eastus", True, 1.0, 0.0, 1)]
    region = _vm(spark, rows, book="region")[0]
    customer = _vm(spark, rows, book="customer")[0]
    assert region.vm_usd == pytest.approx(0.504 + 0.576)        # priced even when spot
    assert customer.vm_spot_usd == pytest.approx(0.9211 + 0.2303)  # unknown in this book: default pair


def test_dbu_cost_always_on_null_workers(spark):
    df = spark.createDataFrame([(24, 4, 2.0), (24, None, 2.0)], "max_pricing_units long, max_workers long, node_hours double")
    r = op.dbu_cost_always_on(df, 0.5).collect()
    assert r[0].dbus == 64.0 and r[0].dbu_usd == 32.0
    assert r[1].dbus is None and r[1].dbu_usd is None


def test_on_demand_price(spark):
    usage = spark.createDataFrame([("us-east-1", 32.0), ("nowhere", 10.0), (None, 10.0), ("ap-southeast-2", 1.0)],
                                  "region string, dbus double")
    r = {x.region: x for x in op.dbu_cost_on_demand(usage, 0, 0.5).collect()}
    assert r["us-east-1"].on_demand_usd == pytest.approx(22.40)
    assert r["nowhere"].on_demand_usd == pytest.approx(5.0)
    assert r[None].on_demand_usd == pytest.approx(5.0)
    assert r["ap-southeast-2"].on_demand_usd == pytest.approx(0.95)
    r = {x.region: x for x in op.dbu_cost_on_demand(usage, 20, 0.5).collect()}
    assert r["us-east-1"].usd_per_dbu == pytest.approx(0.56)


def test_on_demand_usage_rate(spark):
    sessions = spark.createDataFrame(
        [(1, 7, 3, dt.date(2024, 1, 10), T0, T0 + 3600 * US)],
        "cluster_id long, endpoint_id long, workspace_id long, date date, start_us long, end_autostop_us long")
    day = dt.date(2024, 1, 10)
    wl = spark.createDataFrame([(day, 1, 24, 4, "us-east-1", 1.0, "d", "w"), (day, 1, 20, 2, "us-east-1", 2.0, "e", "w"),
                                (dt.date(2024, 1, 9), 1, 90, 9, "us-east-1", 2.0, "e", "w")],
                               "date date, cluster_id long, pricing_units long, workers long, region string, node_hours double,"
                               " driver_node_type string, worker_node_type string")
    r = op.on_demand_usage(sessions, op.daily_workloads(wl)).collect()
    assert len(r) == 1 and r[0].dbus == pytest.approx(32.0)


def test_statement_intervals_fetch_null_and_ms_floor(spark):
    stmts = spark.createDataFrame(
        [(1, 1, 1, dt.date(2024, 1, 10), dt.datetime(2024, 1, 10, 0, 1, 0, 123456), 2.5, None, "finish"),
         (2, 1, 1, dt.date(2024, 1, 10), dt.datetime(2024, 1, 10, 0, 1, 0), 1.0, 3.0, "error"),
         (3, 1, 1, dt.date(2024, 1, 11), dt.datetime(2024, 1, 11, 0, 1, 0), 1.0, 3.0, "finish")],
        "statement_id long, cluster_id long, workspace_id long, date date, ended_at timestamp_ntz, duration_s double,"
        " fetch_s double, status string")
    r = op.statement_intervals(stmts, dt.date(2024, 1, 10), dt.date(2024, 1, 10)).collect()
    assert len(r) == 1
    assert r[0].fetch_s == 0.0
    assert r[0].end_us == T0 + 60 * US + 123456
    assert r[0].start_us == T0 + 60 * US + 123000 - 2_500_000
    assert len(op.statement_intervals(stmts, dt.date(2024, 1, 10), dt.date(2024, 1, 11), only_finished=False).collect()) == 3


def test_cost_comparison_zero_total(spark):
    od = spark.createDataFrame([("a", 5.0), ("b", 1.0), ("c", 2.0)], "customer_name string, on_demand_usd double")
    ao = spark.createDataFrame([("a", 10.0, 4.0, 6.0), ("b", 0.0, 0.0, 0.0)],
                               "customer_name string, always_on_usd double, dbu_usd double, vm_usd double")
    r = {x.customer_name: x for x in op.cost_comparison(od, ao).collect()}
    assert set(r) == {"a", "b"}
    assert r["a"].team_variation_usd == 1.0 and r["a"].variation_usd == -5.0 and r["a"].variation_pct == -50.0
    assert r["b"].variation_pct is None


def test_totals_are_exact_and_order_free(spark):
    vals = [0.1] * 10 + [1e-7, 2.675]
    df = spark.createDataFrame([(1, v) for v in vals], "endpoint_id long, on_demand_usd double")
    a = op.on_demand_by_endpoint(df).collect()[0].on_demand_usd
    b = op.on_demand_by_endpoint(df.orderBy("on_demand_usd", ascending=False).repartition(5)).collect()[0]
    assert a == b.on_demand_usd == 3.675


def test_price_book_shape():
    assert len(pb.vm_price_rows("customer")) == 88
    assert len(pb.vm_price_rows("region")) == 64
    assert pb.default_pair("us-east-1") == ("i3.8xlarge", "i3.2xlarge")
    assert pb.default_pair("westeurope") == ("Standard_E32ds_v4", "Standard_E8ds_v4")
    assert dict(pb.ON_DEMAND_DBU_USD)["ap-southeast-2"] == 0.95


def test_unknown_customer_raises(spark):
    ws = spark.createDataFrame([(1, "Acme")], "workspace_id long, customer_name string")
    assert op.customer_workspaces(ws, "ACME").count() == 1
    with pytest.raises(op.NoWorkspaceError):
        op.customer_workspaces(ws, "nobody")


def test_top_accounts_tie_break_and_region_case(spark):
    billing = spark.createDataFrame(
        [(dt.date(2020, 1, 1), "b", "EMEA", "SQL_PRO", 5.0), (dt.date(2020, 1, 1), "a", "EMEA", "sql", 5.0),
         (dt.date(2020, 1, 1), "c", "emea", "sql", 50.0), (dt.date(2020, 1, 1), "d", "EMEA", "JOBS", 90.0)],
        "date date, account_name string, sales_region string, sku string, dbus double")
    r = op.top_accounts(billing, dt.date(2020, 1, 1), dt.date(2020, 1, 1), "EM", 1).collect()
    assert [x.account_name for x in r] == ["a"]
    with pytest.raises(op.NoWorkspaceError):
        op.fetch_top_accounts(op.top_accounts(billing, dt.date(2021, 1, 1), dt.date(2021, 1, 1), "EM", 3), 3)


def test_top_accounts_without_workspace_raise(spark):
    billing = spark.createDataFrame([(dt.date(2020, 1, 1), "acme", "EMEA", "sql", 5.0)],
                                    "date date, account_name string, sales_region string, sku string, dbus double")
    top = op.top_accounts(billing, dt.date(2020, 1, 1), dt.date(2020, 1, 1), "EM", 3)
    owned = spark.createDataFrame([(1, "ACME")], "workspace_id long, customer_name string")
    other = spark.createDataFrame([(1, "Globex")], "workspace_id long, customer_name string")
    acc = op.fetch_top_accounts(top, 3, workspaces=owned)
    assert [r.account_name for r in op.account_workspaces(owned, acc).join(acc, F.lower("customer_name") == acc.account_name).collect()] == ["acme"]
    with pytest.raises(op.NoWorkspaceError):
        op.fetch_top_accounts(top, 3, workspaces=other)


def test_scale_conf_partitions():
    from idlecost.session import scale_conf

    big = scale_conf(10 * 1024 ** 4, 8000)
    assert int(big["spark.sql.shuffle.partitions"]) == 81920
    assert big["spark.sql.session.timeZone"] == "UTC"
    assert int(scale_conf(1024, 64)["spark.sql.shuffle.partitions"]) == 64
