"""Price tables with dates, and totals by grouping sets."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from idlecost import operators as op
from idlecost.plans import CustomerAnalysis, RegionAnalysis
from idlecost.sources import price_book as pb
from idlecost.sources.fixtures import CUSTOMER_PARAMS, REGION_PARAMS, load_fixture_inputs
from idlecost.sources.price_periods import dbu_periods, node_periods, price_tables
from idlecost.sources.schemas import DBU_PRICES, VM_PRICES
from idlecost.sources.tables import Inputs, local_table

JAN5, JAN9 = dt.date(2024, 1, 5), dt.date(2024, 1, 9)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_book_as_price_tables_gives_the_same_costs(spark):
    """The prices of the code as input tables without dates: every cost is unchanged."""
    fixture = load_fixture_inputs(spark, SF_SMALL)
    names = ("statements", "endpoints", "cluster_events", "workspaces", "workloads", "billing")
    for kind, params, book in ((CustomerAnalysis, CUSTOMER_PARAMS, "customer"), (RegionAnalysis, REGION_PARAMS, "region")):
        prices = local_table(spark, [(*r, None) for r in pb.vm_price_rows(book)], VM_PRICES)
        dbu = local_table(spark, [(*r, None) for r in pb.ON_DEMAND_DBU_USD], DBU_PRICES)
        dated = Inputs(spark, {n: (lambda n=n: fixture.table(n)) for n in names} | {"vm_prices": prices, "dbu_prices": dbu}, "bigint")
        a, b = kind(fixture, params), kind(dated, params)
        assert _rows(a.always_on_costs) == _rows(b.always_on_costs.select(*a.always_on_costs.columns))
        assert _rows(a.on_demand_costs) == _rows(b.on_demand_costs.select(*a.on_demand_costs.columns))


PRICES = [
    ("us-east-1", "ondemand", "i3.8xlarge", 1.0, None), ("us-east-1", "ondemand", "i3.2xlarge", 0.5, None),
    ("us-east-1", "spot", "i3.8xlarge", 0.25, JAN5), ("us-east-1", "ondemand", "i3.8xlarge", 2.0, JAN5), ("us-east-1", "ondemand", "i3.8xlarge", None, JAN9),
    ("new-region", "ondemand", "i3.8xlarge", 8.0, JAN5), ("new-region", "ondemand", "i3.2xlarge", 4.0, JAN9),
]


def test_price_periods(spark):
    nodes = node_periods(local_table(spark, PRICES, VM_PRICES))
    first, last = dt.date(1, 1, 1), dt.date(9999, 12, 31)
    got = [tuple(r) for r in nodes.where("region = 'us-east-1' AND node_type = 'i3.8xlarge'").orderBy("valid_from").select(
        "on_demand_usd", "spot_usd", "valid_from", "valid_to").collect()]
    assert got == [(1.0, None, first, JAN5), (2.0, 0.25, JAN5, JAN9), (None, 0.25, JAN9, last)]


def test_costs_as_of_their_day(spark):
    """Two price periods, and a region that is priced from a day on; before, it counts as unknown."""
    days = ["2024-01-04", "2024-01-05", "2024-01-09"]
    usage = spark.createDataFrame(
        [(d, r, "i3.8xlarge", "i3.2xlarge", 2, False, 1.0, 0.0) for d in days for r in ("us-east-1", "new-region", None)],
        "date string, region string, driver_node_type string, worker_node_type string, max_workers long, is_spot boolean, node_hours double, dbu_usd double")
    usage = usage.withColumn("date", F.to_date("date"))
    got = {(str(r["date"]), r["region"]): r["total_usd"] for r in op.vm_cost(usage, 0, price_tables(local_table(spark, PRICES, VM_PRICES))).collect()}
    # us-east-1 has no driver price from the 9th on, so no default pair either; new-region's worker is priced from the 9th.
    assert got == {(days[0], "us-east-1"): 2.0, (days[1], "us-east-1"): 3.0, (days[2], "us-east-1"): None,
                   (days[0], "new-region"): 2.0, (days[1], "new-region"): None, (days[2], "new-region"): 16.0,
                   (days[0], None): 2.0, (days[1], None): 3.0, (days[2], None): None}
    dbu = dbu_periods(local_table(spark, [("us-east-1", 0.5, None), ("us-east-1", 0.75, JAN9)], DBU_PRICES))
    sold = usage.withColumn("dbus", F.lit(4.0)).where("region IS NOT NULL")
    got = {(str(r["date"]), r["region"]): r["on_demand_usd"] for r in op.dbu_cost_on_demand(sold, 0, 1.0, dbu).collect()}
    assert got == {**{(d, "us-east-1"): 2.0 for d in days[:2]}, (days[2], "us-east-1"): 3.0, **{(d, "new-region"): 4.0 for d in days}}


def test_reports_of_totals_equal_the_single_reports(spark):
    a = CustomerAnalysis(load_fixture_inputs(spark, SF_SMALL), CUSTOMER_PARAMS)
    r = RegionAnalysis(load_fixture_inputs(spark, SF_SMALL), REGION_PARAMS)
    for run, names in ((a, ["grand_totals", "always_on_by_endpoint", "on_demand_by_endpoint", "cost_comparison_daily"]),
                       (r, ["always_on_by_customer", "on_demand_by_customer", "cost_comparison"])):
        reports = op.reports_of_totals(run.cost_totals())
        for name in names:
            assert _rows(reports[name]) == _rows(getattr(run, name)()), name
    plan = a.cost_totals()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("idlecost-sessions") == 2  # each side of the costs is made once for all levels


@pytest.mark.parametrize("n", [0, 1])
def test_totals_of_nothing_and_of_one_side(spark, n):
    ao = spark.createDataFrame([(1, 10, dt.date(2024, 1, 1), 2.0, 1.0, 0.5, 0.5)] * n,
                               "endpoint_id long, cluster_id long, date date, total_usd double, dbu_usd double, vm_on_demand_usd double, vm_spot_usd double")
    od = spark.createDataFrame([], "endpoint_id long, cluster_id long, date date, dbus double, on_demand_usd double")
    reports = op.reports_of_totals(op.cost_totals(ao, od))
    for name, single in (("grand_totals", op.grand_totals(ao, od)), ("always_on_by_endpoint", op.always_on_by_endpoint(ao)),
                         ("on_demand_by_endpoint", op.on_demand_by_endpoint(od)), ("cost_comparison_daily", op.cost_comparison_daily(ao, od))):
        assert _rows(reports[name]) == _rows(single), name
