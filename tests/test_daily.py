"""Day-by-day runs equal one run, rewrite only the days they change, and may be repeated."""

import datetime as dt
import os
import tempfile

import pytest

from conftest import SF_SMALL
from idlecost import TcoParams
from idlecost.plans import CustomerAnalysis, DailyRuns, RegionAnalysis
from idlecost.sources.fixtures import CUSTOMER_PARAMS, REGION_PARAMS, load_fixture_inputs
from idlecost.sources.tables import Inputs


def _rows(df, cols=None):
    return sorted(map(tuple, (df.select(*cols) if cols else df).collect()), key=repr)


def _equal_one_run(runs, analysis):
    for name, want in (("sessions", analysis.session_table), ("on_demand_costs", analysis.on_demand_costs), ("always_on_costs", analysis.always_on_costs)):
        assert _rows(runs.published(name), want.columns) == _rows(want), name
    assert _rows(runs.sessions(), analysis.session_table.columns) == _rows(analysis.session_table)


@pytest.mark.parametrize("kind,params", [(CustomerAnalysis, CUSTOMER_PARAMS), (RegionAnalysis, REGION_PARAMS)])
def test_runs_of_days_equal_one_run(spark, kind, params):
    analysis = kind(load_fixture_inputs(spark, SF_SMALL), params)
    runs = DailyRuns(analysis, tempfile.mkdtemp(prefix="idlecost-days-"))
    for a, b in ((1, 9), (10, 10), (11, 30)):
        runs.run(dt.date(2024, 1, a), dt.date(2024, 1, b))
    _equal_one_run(runs, analysis)
    reports = runs.reports()
    for name in ("grand_totals", "cost_comparison"):
        if name in reports:
            assert _rows(reports[name]) == _rows(getattr(analysis, name)())


def _hand(spark, statements):
    """Two clusters of one customer; statements: (id, cluster, end, seconds)."""
    t = lambda s: dt.datetime.fromisoformat(s).replace(tzinfo=dt.timezone.utc)
    days = [dt.date(2024, 1, d) for d in range(8, 16)]
    sources = {
        "statements": spark.createDataFrame([(i, c, 1, t(end).date(), t(end), float(s), None, "finish") for i, c, end, s in statements],
                                            "statement_id long, cluster_id long, workspace_id long, date date, ended_at timestamp, duration_s double, fetch_s double, status string"),
        "endpoints": spark.createDataFrame([(1, 5, 1), (2, 6, 1)], "cluster_id long, endpoint_id long, workspace_id long"),
        "cluster_events": spark.createDataFrame([(days[0], "life", {"action": "new", "cluster_id": c}) for c in "12"],
                                                "date date, metric string, tags map<string,string>"),
        "workspaces": spark.createDataFrame([(1, "acme")], "workspace_id long, customer_name string"),
        "workloads": spark.createDataFrame([(d, c, 3.0, 4, 2, False, "us-east-1", "i3.8xlarge", "i3.2xlarge") for d in days for c in (1, 2)],
                                           "date date, cluster_id long, node_hours double, pricing_units long, workers long, is_spot boolean, region string, driver_node_type string, worker_node_type string"),
    }
    params = TcoParams(start_date=days[0], end_date=days[-1], customer_name="acme", lifecycle_metric="life", create_actions=("new",), auto_stop_s=600)
    return CustomerAnalysis(Inputs(spark, sources), params)


STATEMENTS = [
    (1, 1, "2024-01-10T10:05:00", 300), (2, 2, "2024-01-10T10:05:00", 300), (3, 1, "2024-01-11T09:05:00", 300),
    # ends on the 12th, began on the 10th: joins cluster 1's sessions of both days, and the 11th has none left
    (4, 1, "2024-01-12T01:00:00", 39 * 3600), (5, 2, "2024-01-12T00:05:00", 240), (6, 2, "2024-01-12T23:58:00", 60),
    (7, 2, "2024-01-13T00:03:00", 60), (8, 1, "2024-01-15T12:00:00", 10),
]


def test_a_long_statement_joins_days_and_empties_one(spark):
    analysis = _hand(spark, STATEMENTS)
    runs = DailyRuns(analysis, tempfile.mkdtemp(prefix="idlecost-days-"))
    for d in range(10, 12):
        runs.run(dt.date(2024, 1, d))
    assert sorted(str(r["date"]) for r in runs.sessions().collect()) == ["2024-01-10", "2024-01-10", "2024-01-11"]
    changes = runs.run(dt.date(2024, 1, 12))
    assert [d.day for d in changes.session_days] == [10, 11, 12]
    long = [r for r in runs.published("sessions").collect() if r["cluster_id"] == 1]
    assert [(str(r["date"]), r["statements"]) for r in long] == [("2024-01-10", 3)]
    assert runs.published("sessions").where("date = '2024-01-11'").count() == 0

    def files(name, key):
        out = {}
        for folder, _, found in os.walk(f"{runs.out}/{name}"):
            out |= {f"{folder}/{f}": os.stat(f"{folder}/{f}").st_mtime_ns for f in found if key in folder}
        return out

    old = {n: files(n, day) for n, day in (("sessions", "date=2024-01-10"), ("on_demand_costs", "date=2024-01-10"), ("always_on_costs", "span_date=2024-01-10"))}
    changes = runs.run(dt.date(2024, 1, 13))  # extends a session of the 12th over midnight; the 10th stays as it is
    assert [d.day for d in changes.session_days] == [12] and [d.day for d in changes.span_days] == [12, 13]
    assert {n: files(n, d) for n, d in (("sessions", "date=2024-01-10"), ("on_demand_costs", "date=2024-01-10"), ("always_on_costs", "span_date=2024-01-10"))} == old
    changes = runs.run(dt.date(2024, 1, 14), dt.date(2024, 1, 15))
    assert [d.day for d in changes.session_days] == [15] and [d.day for d in changes.span_days] == [12, 13, 14, 15]
    _equal_one_run(runs, analysis)


def test_runs_can_be_repeated_and_come_in_order(spark):
    analysis = _hand(spark, STATEMENTS)
    runs = DailyRuns(analysis, tempfile.mkdtemp(prefix="idlecost-days-"))
    first, rest = (dt.date(2024, 1, 8), dt.date(2024, 1, 11)), (dt.date(2024, 1, 12), dt.date(2024, 1, 15))
    runs.run(*first)
    lost = runs.advance(*rest)  # published never
    assert runs.run(*rest) == lost and runs.runs() == ["2024-01-11", "2024-01-15"]
    _equal_one_run(runs, analysis)
    for days in (first, (dt.date(2024, 1, 15), dt.date(2024, 1, 16))):
        with pytest.raises(ValueError, match="in order"):
            runs.run(*days)
    empty = runs.run(dt.date(2024, 1, 16))
    assert empty.session_days == [] and empty.span_days == []
    _equal_one_run(runs, analysis)
    with pytest.raises(ValueError, match="cluster scope"):
        DailyRuns(CustomerAnalysis(analysis.inputs, analysis.params.with_(session_scope="global")), "/tmp/none")
