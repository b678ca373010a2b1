"""Command line: run one analysis and write its reports.

    python -m idlecost customer --tables tables.json --out s3://bucket/tco/acme \
        --start-date 2024-01-01 --end-date 2024-01-30 --customer-name acme \
        --lifecycle-metric lifecycle --create-action create
    python -m idlecost region --tables tables.json --out /data/tco/emea \
        --start-date 2024-01-01 --end-date 2024-01-30 --sales-region EMEA --top-accounts 20

``tables.json`` maps each logical input (statements, endpoints, cluster_events,
workspaces, workloads, billing) to a catalog table name or a path.  The flags are
the parameters the original notebooks read from widgets.  Use ``--fixtures DIR``
instead of ``--tables`` to run on the driver's test tables.
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import fields

from idlecost.config import TcoParams


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="idlecost", description=__doc__.split("\n\n")[0])
    p.add_argument("analysis", choices=["customer", "region"])
    src = p.add_mutually_exclusive_group(required=True)
    src.add_argument("--tables", help="JSON file: logical input -> table name or path")
    src.add_argument("--fixtures", help="directory of the driver's test tables")
    p.add_argument("--format", default="parquet", help="format of path inputs and of the reports")
    p.add_argument("--out", required=True, help="folder for the reports (shared storage on a cluster)")
    p.add_argument("--master", default=None, help="Spark master for a local run, e.g. local[8]")
    d = {f.name: f.default for f in fields(TcoParams)}
    p.add_argument("--start-date", required=True)
    p.add_argument("--end-date", required=True)
    p.add_argument("--customer-name", help="required by the customer analysis")
    p.add_argument("--lifecycle-metric", help="metric of the lifecycle log's rows; required by the customer analysis")
    p.add_argument("--create-action", action="append", default=[], help="an action that creates a cluster; repeat for several")
    p.add_argument("--cost-per-dbu-always-on", type=float, default=d["cost_per_dbu_always_on"])
    p.add_argument("--vm-discount-pct", type=int, default=d["vm_discount_pct"])
    p.add_argument("--on-demand-discount-pct", type=int, default=d["on_demand_discount_pct"])
    p.add_argument("--auto-stop-s", type=int, default=d["auto_stop_s"])
    p.add_argument("--default-on-demand-price", type=float, default=d["default_on_demand_price"])
    p.add_argument("--sales-region", help="required by the region analysis")
    p.add_argument("--top-accounts", type=int, default=d["top_accounts"])
    p.add_argument("--billing-start-date", help="default: the start date")
    p.add_argument("--billing-end-date", help="default: the end date")
    p.add_argument("--session-scope", choices=["cluster", "global"], default=d["session_scope"])
    p.add_argument("--all-statements", action="store_true",
                   help="keep statements of every status (the region analysis does by default)")
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from idlecost.plans import CustomerAnalysis, RegionAnalysis, write_reports
    from idlecost.session import SESSION_CONF, local_session
    from idlecost.sources import load_inputs
    from idlecost.sources.fixtures import load_fixture_inputs

    if args.master:
        spark = local_session(args.master.removeprefix("local[").rstrip("]") or "*")
    else:
        builder = SparkSession.builder.appName("idlecost")
        for key, value in SESSION_CONF.items():
            builder = builder.config(key, value)
        spark = builder.getOrCreate()

    only_finished = not args.all_statements and args.analysis == "customer"
    params = TcoParams(
        start_date=args.start_date, end_date=args.end_date, customer_name=args.customer_name,
        cost_per_dbu_always_on=args.cost_per_dbu_always_on, vm_discount_pct=args.vm_discount_pct,
        on_demand_discount_pct=args.on_demand_discount_pct, auto_stop_s=args.auto_stop_s,
        default_on_demand_price=args.default_on_demand_price, sales_region=args.sales_region,
        top_accounts=args.top_accounts, billing_start_date=args.billing_start_date,
        billing_end_date=args.billing_end_date, lifecycle_metric=args.lifecycle_metric,
        create_actions=tuple(args.create_action), session_scope=args.session_scope, only_finished=only_finished,
    )
    if args.fixtures:
        inputs = load_fixture_inputs(spark, args.fixtures)
    else:
        with open(args.tables) as fh:
            inputs = load_inputs(spark, json.load(fh), args.format)
    analysis = (CustomerAnalysis if args.analysis == "customer" else RegionAnalysis)(inputs, params)
    written = write_reports(analysis, args.out, fmt=args.format)
    print(json.dumps(written, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
