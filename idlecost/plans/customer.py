"""Single-customer analysis, broken down by endpoint (the first notebook, re-expressed).

Attributes are lazy DataFrames, but for two tables that are written to the shared folder
when first needed: the map of the analysed clusters (its emptiness is the guard), and the
sessions, from which all costs and reports come.  ``plans.write_reports`` writes every report.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idlecost import operators as op
from idlecost.config import TcoParams
from idlecost.session import check_session, stored
from idlecost.sources.layout import salted_map
from idlecost.sources.price_periods import PriceTables, dbu_periods, price_tables
from idlecost.sources.tables import Inputs


KEYS = ("cluster_id", "endpoint_id", "workspace_id")


class CustomerAnalysis:
    def __init__(self, inputs: Inputs, params: TcoParams, check: bool = True):
        check_session(inputs.spark)
        params.require("customer_name", "lifecycle_metric", "create_actions")
        self.inputs = inputs
        self.params = params
        self.check = check

    # -- preparation ---------------------------------------------------------
    @cached_property
    def intervals(self) -> DataFrame:
        p = self.params
        return op.statement_intervals(self.inputs.statements, p.start_date, p.end_date, p.only_finished)

    @cached_property
    def non_serverless_clusters(self) -> DataFrame:
        p = self.params
        return op.non_serverless_clusters(self.inputs.cluster_events, p.start_date, p.end_date,
                                          p.lifecycle_metric, p.create_actions, self.inputs.id_type)

    @cached_property
    def customer_clusters(self) -> DataFrame:
        """The customer's (workspace, cluster, endpoint) rows."""
        return op.customer_clusters(self.inputs.workspaces, self.inputs.endpoints, self.params.customer_name, check=False)

    @cached_property
    def analysed_clusters(self) -> DataFrame:
        """(cluster, endpoint) of the analysis, stored, so that the planner knows its size.

        An empty one tells an unknown customer name, which raises.
        """
        clusters = stored(op.cluster_map(self.customer_clusters, self.non_serverless_clusters), "clusters")
        if self.check and clusters.isEmpty():
            op.customer_workspaces(self.inputs.workspaces, self.params.customer_name, check=True)
        return clusters

    @cached_property
    def statements(self) -> DataFrame:
        """Attributed statements (the shared input of both cost branches)."""
        return self.statements_of(self.intervals)

    @cached_property
    def _statement_map(self) -> DataFrame:
        layout = self.inputs.layout
        return salted_map(self.analysed_clusters, layout) if layout else self.analysed_clusters

    def statements_of(self, intervals: DataFrame) -> DataFrame:
        return op.attributed_statements(intervals, self._statement_map)

    def daily_workloads(self, start_date: dt.date | None = None, end_date: dt.date | None = None) -> DataFrame:
        """Daily workloads of the analysed clusters (from ``start_date``, else the first day of any session)."""
        ids = self.analysed_clusters.select("cluster_id")
        return op.daily_workloads(self.inputs.workloads.join(ids, "cluster_id", "left_semi"), end_date or self.params.end_date,
                                  start_date or self.first_day)

    # -- always-on -----------------------------------------------------------
    @cached_property
    def active_span(self) -> DataFrame:
        return op.active_span(self.statements)

    @staticmethod
    def _spans_of(sessions: DataFrame) -> DataFrame:
        """``active_span`` taken over the sessions: they partition a warehouse's statements, so min start and max end agree."""
        keys = [c for c in KEYS if c in sessions.columns]
        return op.active_span(sessions.select(*keys, "start_us", "end_us"), keys)

    @cached_property
    def always_on_daily(self) -> DataFrame:
        return op.always_on_daily(self._spans_of(self.session_table), self.daily_workloads())

    @cached_property
    def always_on_dbu(self) -> DataFrame:
        return op.dbu_cost_always_on(self.always_on_daily, self.params.cost_per_dbu_always_on)

    @cached_property
    def always_on_costs(self) -> DataFrame:
        return op.vm_cost(self.always_on_dbu, self.params.vm_discount_pct, self._vm_book)

    @cached_property
    def _vm_book(self) -> str | PriceTables:
        """The price tables of the inputs, stored as periods, or the price book of the code."""
        prices = self.inputs.vm_prices
        return "customer" if prices is None else PriceTables(*[stored(t, "vm-prices") for t in price_tables(prices)])

    @cached_property
    def _dbu_book(self) -> DataFrame | None:
        prices = self.inputs.dbu_prices
        return None if prices is None else stored(dbu_periods(prices), "dbu-prices")

    def always_on_costs_of(self, sessions: DataFrame, start_date: dt.date | None = None) -> DataFrame:
        """The same rows as ``always_on_costs``, from the given sessions."""
        return self._priced(op.always_on_daily(self._spans_of(sessions), self.daily_workloads(start_date)))

    def always_on_costs_on(self, spans: DataFrame, days: list[dt.date]) -> DataFrame:
        """The costs of the spans' slices on ``days``, which ``span_date`` tells."""
        return self._priced(op.always_on_daily(spans, self.daily_workloads(min(days), max(days)), days))

    def _priced(self, daily: DataFrame) -> DataFrame:
        p = self.params
        return op.vm_cost(op.dbu_cost_always_on(daily, p.cost_per_dbu_always_on), p.vm_discount_pct, self._vm_book)

    # -- on-demand -----------------------------------------------------------
    @cached_property
    def sessions(self) -> DataFrame:
        p = self.params
        return op.idle_sessions(self.statements, p.auto_stop_s, p.session_scope, bucket_s=p.session_bucket_s)

    @cached_property
    def session_table(self) -> DataFrame:
        """The sessions, stored when first needed: the analysis' only pass over the statement log.
        Spans, costs and reports come from this table of one row a session."""
        return stored(self.sessions, "sessions")

    @cached_property
    def first_day(self) -> dt.date | None:
        """The first day any session starts on, an exact lower bound of the workloads that are needed."""
        return self.session_table.agg(F.min("date")).first()[0]

    @cached_property
    def on_demand_usage(self) -> DataFrame:
        return op.on_demand_usage(self.session_table, self.daily_workloads())

    @cached_property
    def on_demand_costs(self) -> DataFrame:
        return self.on_demand_costs_of(self.session_table)

    def on_demand_costs_of(self, sessions: DataFrame, start_date: dt.date | None = None) -> DataFrame:
        p = self.params
        usage = op.on_demand_usage(sessions, self.daily_workloads(start_date))
        return op.dbu_cost_on_demand(usage, p.on_demand_discount_pct, p.default_on_demand_price, self._dbu_book)

    # -- reports -------------------------------------------------------------
    def always_on_by_endpoint(self, sort: bool = True) -> DataFrame:
        return op.always_on_by_endpoint(self.always_on_costs, sort)

    def on_demand_by_endpoint(self, sort: bool = True) -> DataFrame:
        return op.on_demand_by_endpoint(self.on_demand_costs, sort)

    def cost_totals(self) -> DataFrame:
        """The totals of both sides at every level, one pass over the costs."""
        return op.cost_totals(self.always_on_costs, self.on_demand_costs)

    def grand_totals(self) -> DataFrame:
        return op.grand_totals(self.always_on_costs, self.on_demand_costs)

    def cost_comparison_daily(self) -> DataFrame:
        return op.cost_comparison_daily(self.always_on_costs, self.on_demand_costs)

    def timeline_sessions(self) -> DataFrame:
        """Per-day bars of on-demand sessions including their auto-stop tail."""
        return _bars(self.session_table, "end_autostop_us")

    def timeline_statements(self) -> DataFrame:
        return _bars(self.statements, "end_us")

    def timeline_always_on(self) -> DataFrame:
        return _bars(self.always_on_costs, "end_us")

    def totals(self, sessions: DataFrame, always_on: DataFrame, on_demand: DataFrame) -> dict[str, DataFrame]:
        """Every further report, from the written sessions and costs; one pass over the costs makes all totals."""
        reports = op.reports_of_totals(stored(op.cost_totals(always_on, on_demand), "cost-totals"))
        return {name: reports[name] for name in ("always_on_by_endpoint", "on_demand_by_endpoint", "grand_totals", "cost_comparison_daily")} | {
            "timeline_sessions": _bars(sessions, "end_autostop_us"),
            "timeline_always_on": _bars(always_on, "end_us"),
        }


def _bars(df: DataFrame, end: str) -> DataFrame:
    return op.timeline_segments(df, "start_us", end, ["endpoint_id", "cluster_id"])
