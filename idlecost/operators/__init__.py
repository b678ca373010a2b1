"""DataFrame operators: each takes DataFrames and parameters and returns a DataFrame."""

from idlecost.operators.attribution import (
    NoWorkspaceError,
    account_clusters,
    account_workspaces,
    active_span,
    attributed_statements,
    attributed_statements_region,
    cluster_map,
    customer_clusters,
    customer_workspaces,
    fetch_top_accounts,
    non_serverless_clusters,
    top_accounts,
)
from idlecost.operators.intervals import day_slices, statement_intervals
from idlecost.operators.pricing import dbu_cost_always_on, dbu_cost_on_demand, vm_cost, vm_cost_region, with_vm_rates
from idlecost.operators.reports import (
    always_on_by_customer,
    always_on_by_endpoint,
    cost_comparison,
    cost_comparison_daily,
    cost_totals,
    grand_totals,
    on_demand_by_customer,
    on_demand_by_endpoint,
    reports_of_totals,
)
from idlecost.operators.sessions import idle_sessions, merge_sessions, resume_sessions
from idlecost.operators.timeline import timeline_segments
from idlecost.operators.usage import always_on_daily, always_on_daily_region, daily_workloads, on_demand_usage

__all__ = [
    "NoWorkspaceError",
    "account_clusters",
    "account_workspaces",
    "active_span",
    "always_on_by_customer",
    "always_on_by_endpoint",
    "always_on_daily",
    "always_on_daily_region",
    "attributed_statements",
    "attributed_statements_region",
    "cluster_map",
    "cost_comparison",
    "cost_comparison_daily",
    "cost_totals",
    "customer_clusters",
    "customer_workspaces",
    "daily_workloads",
    "day_slices",
    "dbu_cost_always_on",
    "dbu_cost_on_demand",
    "fetch_top_accounts",
    "grand_totals",
    "idle_sessions",
    "merge_sessions",
    "non_serverless_clusters",
    "on_demand_by_customer",
    "on_demand_by_endpoint",
    "on_demand_usage",
    "reports_of_totals",
    "resume_sessions",
    "statement_intervals",
    "timeline_segments",
    "top_accounts",
    "vm_cost",
    "vm_cost_region",
    "with_vm_rates",
]
