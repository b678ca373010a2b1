"""Plan shape: no single-partition exchange over statements, no Python UDF, broadcast price joins,
pushed scan filters."""

import pytest

from conftest import SF_SMALL

import __spark_entry__ as se


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["idle_sessions", "timeline_segments", "on_demand_by_endpoint"])
def test_cluster_sessions_never_single_partition_over_statements(spark, key):
    plan = _plan(se.queries()[key](spark, SF_SMALL))
    assert "SinglePartition" not in plan


def test_global_sessions_single_partition_only_over_cells(spark):
    plan = _plan(se.queries()["idle_sessions_global"](spark, SF_SMALL))
    # exactly one single-partition exchange: the one under the prefix scan of the
    # cells (one row a cell of the time-out's width), never one over the statements
    lines = plan.split("\n")
    single = [i for i, line in enumerate(lines) if "Exchange SinglePartition" in line]
    assert len(single) == 1
    below = "\n".join(lines[single[0]: single[0] + 4])
    assert "HashAggregate(keys=[_cell" in below


@pytest.mark.parametrize("key", sorted(se._Q))
def test_no_python_udf(spark, key):
    plan = _plan(se.queries()[key](spark, SF_SMALL))
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


@pytest.mark.parametrize("key", ["vm_cost", "vm_cost_region", "dbu_cost_on_demand"])
def test_price_joins_are_broadcast(spark, key):
    plan = _plan(se.queries()[key](spark, SF_SMALL))
    assert "BroadcastHashJoin" in plan
    assert "SortMergeJoin [_region_eff" not in plan


def test_statement_scan_prunes_columns_and_pushes_date(spark):
    plan = _plan(se.queries()["statement_intervals"](spark, SF_SMALL))
    scan = [line for line in plan.split("\n") if "FileScan parquet" in line][0]
    assert "GreaterThanOrEqual(ts" in scan and "LessThan(ts" in scan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string" in scan


def test_sessions_read_the_statements_once(spark):
    plan = _plan(se.queries()["idle_sessions"](spark, SF_SMALL))
    assert plan.count("value:double,props:string>") == 1


@pytest.mark.parametrize("key", ["idle_sessions", "idle_sessions_global"])
def test_statements_are_aggregated_to_cells_before_their_shuffle(spark, key):
    """Under the first exchange above the statement scan there is a partial aggregate by cell."""
    plan = _plan(se.queries()[key](spark, SF_SMALL))
    path = _ancestors(plan, "value:double,props:string>")
    below = path[:next(i for i, op in enumerate(path) if op.startswith("Exchange"))]
    assert any(op.startswith("HashAggregate") and "_cell" in op and "partial_min" in op for op in below), path


@pytest.mark.parametrize("gap", [0, 10, 3600])
def test_a_burst_of_one_minute_is_one_row_a_cell(spark, gap):
    """A minute with a third of all rows goes through the shuffle as its cells."""
    from helpers import idle_sessions_plain, intervals_df
    from idlecost.functions.time import MICROS_PER_SECOND
    from idlecost.operators.sessions import idle_sessions

    rows = [(7, 600 + i * 0.01, 601 + i * 0.01) for i in range(3000)] + [(i % 9, i * 37, i * 37 + 5) for i in range(6000)]
    df = intervals_df(spark, rows)
    got = idle_sessions(df, gap, group_by=["cluster_id"])
    want = idle_sessions_plain(df, gap * MICROS_PER_SECOND, ["cluster_id"], ["cluster_id"])
    cols = ["cluster_id", "start_us", "end_us", "statements"]
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())


def test_a_burst_at_gap_0_spreads_over_tasks(spark):
    """A third of all rows in one minute of one cluster, every start its own cell: the largest part is near the median."""
    import statistics

    from helpers import idle_sessions_plain, intervals_df
    from idlecost.operators import sessions

    rows = [(7, 600 + i * 0.005, 600 + i * 0.005 + (i % 3) * 0.004) for i in range(12_000)] + [(i % 9, i * 37, i * 37 + 5) for i in range(24_000)]
    df = intervals_df(spark, rows)
    got = sessions.idle_sessions(df, 0, group_by=["cluster_id"])
    want = idle_sessions_plain(df, 0, ["cluster_id"], ["cluster_id"])
    cols = ["cluster_id", "start_us", "end_us", "statements"]
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many tasks as a large input has
    try:
        cells = df.select("cluster_id", df.start_us.alias("_cell"))
        parts = [r[1] for r in sessions._range_parts(cells, ["cluster_id"]).groupBy("_range").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(parts) > 4 and max(parts) < 2 * statistics.median(parts)


def _ancestors(plan: str, needle: str) -> list[str]:
    """Operators on the path from the root to the first line containing ``needle``."""
    lines = plan.split("\n")
    idx = next(i for i, line in enumerate(lines) if needle in line)

    def depth(line: str) -> int:
        return len(line) - len(line.lstrip(" :+-"))

    path, d = [], depth(lines[idx])
    for line in reversed(lines[:idx]):
        if depth(line) < d:
            path.append(line.strip(" :+-"))
            d = depth(line)
    return path


@pytest.mark.parametrize("key", ["attributed_statements", "attributed_statements_region"])
def test_statements_reach_attribution_without_a_shuffle(spark, key):
    """The stored cluster map has a known, small size: Spark broadcasts it, and the statements aren't shuffled."""
    plan = _plan(se.queries()[key](spark, SF_SMALL))
    path = _ancestors(plan, "value:double,props:string>")  # the statement scan (fetch time is in props)
    assert not [op for op in path if op.startswith("Exchange")], path
    assert any(op.startswith("BroadcastHashJoin") for op in path)


def test_unknown_customer_raises_in_analysis(spark):
    from idlecost.operators import NoWorkspaceError
    from idlecost.plans import CustomerAnalysis
    from idlecost.sources.fixtures import CUSTOMER_PARAMS, load_fixture_inputs

    a = CustomerAnalysis(load_fixture_inputs(spark, SF_SMALL), CUSTOMER_PARAMS.with_(customer_name="nobody"))
    with pytest.raises(NoWorkspaceError):
        a.statements


@pytest.mark.parametrize("key,scan", [
    ("always_on_daily", "user_id:bigint,value:double>"),                 # workloads scan with node hours
    ("vm_cost_region", "user_id:bigint,value:double>"),
    ("on_demand_usage", "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>"),
])
def test_workloads_cut_to_analysed_clusters_before_any_shuffle(spark, key, scan):
    plan = _plan(se.queries()[key](spark, SF_SMALL))
    path = _ancestors(plan, scan)
    before_shuffle = []
    for op in path:
        if op.startswith("Exchange") or op.startswith("BroadcastExchange"):
            break
        before_shuffle.append(op)
    assert any(op.startswith("BroadcastHashJoin") and "LeftSemi" in op for op in before_shuffle), path


def test_an_analysis_reads_the_statement_log_once(spark, monkeypatch):
    """The stored sessions are the only pass over the log: no cost query and no report scans it again."""
    from pyspark.sql import DataFrameWriter

    from idlecost.plans import CustomerAnalysis, RegionAnalysis
    from idlecost.sources.fixtures import CUSTOMER_PARAMS, REGION_PARAMS, load_fixture_inputs

    needle, written = "value:double,props:string>", []
    real = DataFrameWriter.parquet

    def parquet(self, *args, **kwargs):
        written.append(_plan(self._df))
        return real(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    a = CustomerAnalysis(load_fixture_inputs(spark, SF_SMALL), CUSTOMER_PARAMS)
    r = RegionAnalysis(load_fixture_inputs(spark, SF_SMALL), REGION_PARAMS)
    for analysis, reports in ((a, [a.grand_totals, a.cost_comparison_daily, a.always_on_by_endpoint, a.on_demand_by_endpoint,
                                   a.timeline_sessions, a.timeline_always_on]),
                              (r, [r.cost_comparison, r.always_on_by_customer, r.on_demand_by_customer])):
        written.clear()
        for report in reports:
            df = report()
            df.collect()
            assert needle not in df._jdf.queryExecution().executedPlan().toString()
        assert sum(plan.count(needle) for plan in written) == 1


@pytest.mark.parametrize("key,scan", [
    ("always_on_daily", "user_id:bigint,value:double>"), ("vm_cost_region", "user_id:bigint,value:double>"),
    ("on_demand_usage", "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>"),
    ("cost_comparison", "user_id:bigint,value:double>"),
])
def test_workloads_scan_has_both_date_bounds_without_the_sink(spark, key, scan):
    lines = [x for x in _plan(se.queries()[key](spark, SF_SMALL)).split("\n") if "FileScan parquet" in x and scan in x]
    assert lines and all("GreaterThanOrEqual(ts" in x and "LessThan(ts" in x for x in lines)


@pytest.mark.parametrize("key", ["always_on_daily", "always_on_daily_region", "on_demand_usage"])
def test_workloads_are_aggregated_before_the_join(spark, key):
    """No aggregate keyed by a slice's or session's start stands above the join with workloads."""
    plan = _plan(se.queries()[key](spark, SF_SMALL))
    lines = plan.split("\n")
    join = next(i for i, line in enumerate(lines) if "Join [date#" in line)
    assert not [line for line in lines[:join] if "HashAggregate" in line]


def test_no_plan_collects_into_one_partition_and_no_counting(spark):
    import pathlib

    import idlecost

    for path in pathlib.Path(idlecost.__file__).parent.rglob("*.py"):
        if "llm" not in path.parts:
            text = path.read_text()
            assert "coalesce(1)" not in text and "localCheckpoint" not in text, path
            assert text.count(".limit(") <= (2 if path.name == "attribution.py" else 0), path


def test_workspaces_are_all_customers(spark):
    from idlecost.sources.fixtures import load_fixture_inputs

    for sf in (SF_SMALL, "/root/testdata/sf0.01"):
        assert load_fixture_inputs(spark, sf).workspaces.count() == spark.read.parquet(f"{sf}/customer.parquet").count()
