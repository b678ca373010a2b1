"""End to end through storage: inputs written as tables, loaded by name, reports written."""

import tempfile

import pytest

from conftest import SF_SMALL
from idlecost.plans import CustomerAnalysis, RegionAnalysis, write_reports
from idlecost.sources import load_inputs
from idlecost.sources.fixtures import CUSTOMER_PARAMS, REGION_PARAMS, load_fixture_inputs
from idlecost.sources.schemas import SCHEMAS

import __spark_entry__ as se


def _rows(df, cols=None):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


@pytest.fixture(scope="module")
def inputs(spark):
    base = tempfile.mkdtemp(prefix="idlecost-sink-")
    fixture = load_fixture_inputs(spark, SF_SMALL)
    for name in SCHEMAS:
        getattr(fixture, name).write.parquet(f"{base}/in/{name}")
    return load_inputs(spark, {name: f"{base}/in/{name}" for name in SCHEMAS})


def test_load_inputs_and_write_reports(spark, inputs):
    base = tempfile.mkdtemp(prefix="idlecost-sink-")
    written = write_reports(RegionAnalysis(inputs, REGION_PARAMS), f"{base}/region")
    assert set(written) == {"sessions", "always_on_costs", "on_demand_costs", "always_on_by_customer",
                            "on_demand_by_customer", "cost_comparison"}
    got = spark.read.parquet(written["cost_comparison"])
    want = se.queries()["cost_comparison"](spark, SF_SMALL)
    assert _rows(got, want.columns) == _rows(want)

    written = write_reports(CustomerAnalysis(inputs, CUSTOMER_PARAMS), f"{base}/customer")
    for name in ("grand_totals", "cost_comparison_daily", "timeline_always_on"):
        want = se.queries()[{"timeline_always_on": "timeline_segments_always_on"}.get(name, name)](spark, SF_SMALL)
        got = se._check_view(spark.read.parquet(written[name]))
        assert _rows(got, want.columns) == _rows(want)


def _scans(df, path: str) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count(path)


def test_sink_reads_the_statement_log_once(spark, inputs, monkeypatch):
    """Also after a report was shown; the workloads scan then has both date bounds."""
    from pyspark.sql import DataFrameWriter

    analysis = RegionAnalysis(inputs, REGION_PARAMS)
    analysis.cost_comparison().collect()
    seen = []
    real = DataFrameWriter.save

    def save(self, *args, **kwargs):
        seen.append(self._df._jdf.queryExecution().executedPlan().toString())
        return real(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "save", save)
    write_reports(analysis, tempfile.mkdtemp(prefix="idlecost-sink-") + "/out")
    assert sum(plan.count("/in/statements") for plan in seen) == 1
    scans = [line for plan in seen for line in plan.split("\n") if "FileScan" in line and "/in/workloads" in line]
    assert scans and all("GreaterThanOrEqual(date" in s and "LessThanOrEqual(date" in s for s in scans)


def test_missing_column_is_reported(spark):
    from idlecost.sources.schemas import require_columns
    with pytest.raises(ValueError, match="missing column"):
        require_columns(spark.range(1), "statements")
