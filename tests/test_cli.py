"""The command line runs an analysis and writes its reports."""

import json
import tempfile

from conftest import SF_SMALL
from idlecost.sources.fixtures import CUSTOMER_PARAMS

import __spark_entry__ as se


def test_cli_customer_reports(spark, capsys):
    from idlecost.__main__ import main

    out = tempfile.mkdtemp(prefix="idlecost-cli-") + "/customer"
    p = CUSTOMER_PARAMS
    assert main(["customer", "--fixtures", SF_SMALL, "--out", out, "--master", "local[2]", "--start-date", "2024-01-01",
                 "--end-date", "2024-01-30", "--customer-name", p.customer_name, "--lifecycle-metric", p.lifecycle_metric,
                 *(x for a in p.create_actions for x in ("--create-action", a))]) == 0
    written = json.loads(capsys.readouterr().out)
    assert set(written) == {"sessions", "always_on_costs", "on_demand_costs", "always_on_by_endpoint", "on_demand_by_endpoint",
                            "grand_totals", "cost_comparison_daily", "timeline_sessions", "timeline_always_on"}
    got = sorted(tuple(r) for r in spark.read.parquet(written["grand_totals"]).collect())
    want = sorted(tuple(r) for r in se.queries()["grand_totals"](spark, SF_SMALL).collect())
    assert got == want
