"""Top-X customers of a sales region (the second notebook, re-expressed)."""

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

KEYS = ("cluster_id", "endpoint_id", "workspace_id", "customer_name")


class RegionAnalysis:
    def __init__(self, inputs: Inputs, params: TcoParams, check: bool = True):
        check_session(inputs.spark)
        params.require("sales_region")
        self.inputs = inputs
        self.params = params
        self.check = check

    @cached_property
    def intervals(self) -> DataFrame:
        p = self.params
        return op.statement_intervals(self.inputs.statements, p.start_date, p.end_date, p.only_finished)

    @cached_property
    def top_accounts(self) -> DataFrame:
        p = self.params
        return op.top_accounts(self.inputs.billing, p.billing_start_date, p.billing_end_date, p.sales_region,
                               p.top_accounts, p.sku_substring)

    @cached_property
    def selected_accounts(self) -> DataFrame:
        """The top accounts, computed once and held as a local table of at most ``top_accounts`` rows."""
        return op.fetch_top_accounts(self.top_accounts, self.params.top_accounts, self.check, self.inputs.workspaces)

    @cached_property
    def account_workspaces(self) -> DataFrame:
        # the guard already ran with the top-k job (``selected_accounts``)
        return op.account_workspaces(self.inputs.workspaces, self.selected_accounts, check=False)

    @cached_property
    def account_clusters(self) -> DataFrame:
        """Mapping rows of the selected accounts, stored, so that the planner knows their size."""
        return stored(op.account_clusters(self.inputs.endpoints, self.account_workspaces), "account-clusters")

    @cached_property
    def statements(self) -> DataFrame:
        return self.statements_of(self.intervals)

    @cached_property
    def _statement_map(self) -> DataFrame:
        layout = self.inputs.layout
        return salted_map(self.account_clusters, layout) if layout else self.account_clusters

    def statements_of(self, intervals: DataFrame) -> DataFrame:
        return op.attributed_statements_region(intervals, self._statement_map)

    def daily_workloads(self, start_date: dt.date | None = None, end_date: dt.date | None = None) -> DataFrame:
        """Daily workloads of the selected accounts' clusters (from ``start_date``, else the first day of any session)."""
        ids = self.account_clusters.select("cluster_id")
        return op.daily_workloads(self.inputs.workloads.join(ids, "cluster_id", "left_semi"), end_date or self.params.end_date,
                                  start_date or self.first_day)

    @cached_property
    def active_span(self) -> DataFrame:
        return op.active_span(self.statements)

    @cached_property
    def always_on_daily(self) -> DataFrame:
        return op.always_on_daily_region(self._spans_of(self.session_table), self.daily_workloads())

    @cached_property
    def always_on_costs(self) -> DataFrame:
        return self._priced(self.always_on_daily)

    def _priced(self, daily: DataFrame) -> DataFrame:
        p = self.params
        return op.vm_cost_region(op.dbu_cost_always_on(daily, p.cost_per_dbu_always_on), p.vm_discount_pct, self._vm_book)

    @cached_property
    def _vm_book(self) -> str | PriceTables:
        """The price tables of the inputs, stored as periods, or the price book of the code."""
        prices = self.inputs.vm_prices
        return "region" if prices is None else PriceTables(*[stored(t, "vm-prices") for t in price_tables(prices)])

    @cached_property
    def _dbu_book(self) -> DataFrame | None:
        prices = self.inputs.dbu_prices
        return None if prices is None else stored(dbu_periods(prices), "dbu-prices")

    def always_on_costs_of(self, sessions: DataFrame, start_date: dt.date | None = None) -> DataFrame:
        """The same rows as ``always_on_costs``, from the given sessions."""
        return self._priced(op.always_on_daily_region(self._spans_of(sessions), self.daily_workloads(start_date)))

    def always_on_costs_on(self, spans: DataFrame, days: list[dt.date]) -> DataFrame:
        """The costs of the spans' slices on ``days``, which ``span_date`` tells."""
        return self._priced(op.always_on_daily_region(spans, self.daily_workloads(min(days), max(days)), days))

    @staticmethod
    def _spans_of(sessions: DataFrame) -> DataFrame:
        """``active_span`` taken over the sessions: they partition a warehouse's statements, so min start and max end agree."""
        keys = [c for c in KEYS if c in sessions.columns]
        return op.active_span(sessions.select(*keys, "start_us", "end_us"), keys)

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
    def on_demand_costs(self) -> DataFrame:
        return self.on_demand_costs_of(self.session_table)

    def on_demand_costs_of(self, sessions: DataFrame, start_date: dt.date | None = None) -> DataFrame:
        p = self.params
        usage = op.on_demand_usage(sessions, self.daily_workloads(start_date))
        return op.dbu_cost_on_demand(usage, p.on_demand_discount_pct, p.default_on_demand_price, self._dbu_book)

    def always_on_by_customer(self, sort: bool = True) -> DataFrame:
        return op.always_on_by_customer(self.always_on_costs, sort)

    def on_demand_by_customer(self, sort: bool = True) -> DataFrame:
        return op.on_demand_by_customer(self.on_demand_costs, sort)

    def cost_totals(self) -> DataFrame:
        """The totals of both sides at every level, one pass over the costs."""
        return op.cost_totals(self.always_on_costs, self.on_demand_costs)

    def cost_comparison(self) -> DataFrame:
        return op.cost_comparison(self.on_demand_by_customer(sort=False), self.always_on_by_customer(sort=False))

    def totals(self, sessions: DataFrame, always_on: DataFrame, on_demand: DataFrame) -> dict[str, DataFrame]:
        """Every further report, from the written sessions and costs; one pass over the costs makes all totals."""
        reports = op.reports_of_totals(stored(op.cost_totals(always_on, on_demand), "cost-totals"))
        return {name: reports[name] for name in ("always_on_by_customer", "on_demand_by_customer", "cost_comparison")}
