"""Which statements belong to the analysis."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idlecost.functions.money import from_micros, sum_micros
from idlecost.sources.schemas import require_columns
from idlecost.sources.tables import local_table


class NoWorkspaceError(ValueError):
    """The customer / account filter matched no workspace."""


def non_serverless_clusters(
    cluster_events: DataFrame,
    start_date: dt.date,
    end_date: dt.date,
    metric: str,
    create_actions: tuple[str, ...],
    id_type: str | None = None,
) -> DataFrame:
    """Distinct ids of clusters created in the range whose serverless flag is 'false' or missing.

    ``metric`` and ``create_actions`` are what the lifecycle log calls its rows and the
    creation of a cluster.  Ids are strings; with ``id_type`` they are cast to it, and
    ids that don't convert are left out.

    Date and metric are plain columns, so both filters reach the scan; the
    action and flag live in the ``tags`` map.
    """
    require_columns(cluster_events, "cluster_events", ["date", "metric", "tags"])
    flag = F.coalesce(F.col("tags").getItem("is_serverless"), F.lit("false"))
    cluster = F.col("tags").getItem("cluster_id")
    if id_type and id_type != "string":
        cluster = cluster.try_cast(id_type)
    return (
        cluster_events.filter(F.col("date").between(F.lit(start_date), F.lit(end_date)))
        .filter(F.col("metric") == F.lit(metric))
        .filter(F.col("tags").getItem("action").isin(*create_actions))
        .filter(flag == F.lit("false"))
        .select(cluster.alias("cluster_id"))
        .filter(F.col("cluster_id").isNotNull())
        .distinct()
    )


def customer_workspaces(workspaces: DataFrame, customer_name: str, check: bool = True) -> DataFrame:
    """Workspace ids of one customer, name compared case-insensitively.

    ``check`` runs one small job (``isEmpty``) and raises on an unknown name.
    """
    ws = workspaces.filter(F.lower(F.col("customer_name")) == F.lower(F.lit(customer_name))).select("workspace_id")
    if check and ws.isEmpty():
        raise NoWorkspaceError(f"no workspace belongs to customer {customer_name!r}")
    return ws


def customer_clusters(workspaces: DataFrame, endpoints: DataFrame, customer_name: str, check: bool = True) -> DataFrame:
    """(workspace_id, cluster_id, endpoint_id) of one customer's warehouses (C3 + J1)."""
    ws = customer_workspaces(workspaces, customer_name, check)
    return ws.join(endpoints.select("workspace_id", "cluster_id", "endpoint_id"), "workspace_id")


def top_accounts(
    billing: DataFrame,
    start_date: dt.date,
    end_date: dt.date,
    sales_region: str,
    top_x: int,
    sku_substring: str = "sql",
) -> DataFrame:
    """The ``top_x`` accounts by SQL DBUs in sales regions whose name contains ``sales_region`` (C4).

    The region match is case-sensitive, the SKU match is not.  DBUs are summed
    exactly (millionths); ties go to the smaller account name.  ``orderBy +
    limit`` plans as a per-partition top-k merged once, so only ``top_x`` rows
    per partition move.
    """
    b = (
        billing.filter(F.col("date").between(F.lit(start_date), F.lit(end_date)))
        .filter(F.col("sales_region").contains(sales_region))
        .filter(F.lower(F.col("sku")).contains(sku_substring.lower()))
    )
    totals = b.groupBy("account_name").agg(sum_micros("dbus").alias("_dbus"))
    top = totals.orderBy(F.col("_dbus").desc(), F.col("account_name").asc()).limit(top_x)
    return top.select("account_name", from_micros("_dbus").alias("total_dbus"))


def fetch_top_accounts(top: DataFrame, top_x: int, check: bool = True,
                       workspaces: DataFrame | None = None) -> DataFrame:
    """Run the top-k once and keep its rows as a local table.

    The result has at most ``top_x`` rows (a parameter, not a data size), so
    holding it on the driver is bounded; downstream joins then broadcast a
    literal table instead of recomputing the billing aggregation for the guard
    and again for the query.  With ``workspaces`` the same job also tells which
    accounts own a workspace, and the guard raises when none does.
    """
    q = top.limit(top_x)
    if workspaces is not None:
        names = workspaces.select(F.lower(F.col("customer_name")).alias("_name")).distinct()
        q = q.join(names, F.lower(q["account_name"]) == names["_name"], "left").select(
            "account_name", "total_dbus", F.col("_name").isNotNull().alias("_owned"))
    rows = q.collect()
    if check and not rows:
        raise NoWorkspaceError("no account has SQL usage in the selected sales region and dates")
    if check and workspaces is not None and not any(r["_owned"] for r in rows):
        raise NoWorkspaceError("no workspace belongs to the selected accounts")
    return local_table(top.sparkSession, [(r["account_name"], r["total_dbus"]) for r in rows], top.schema)


def account_workspaces(workspaces: DataFrame, accounts: DataFrame, check: bool = True) -> DataFrame:
    """(workspace_id, customer_name) of the given accounts, names compared case-insensitively.

    ``accounts`` is a top-k result, so it is broadcast: its size is bounded by k.
    """
    acc = F.broadcast(accounts.select(F.lower(F.col("account_name")).alias("_account")).distinct())
    ws = workspaces.join(acc, F.lower(workspaces["customer_name"]) == acc["_account"]).select(
        "workspace_id", "customer_name"
    )
    if check and ws.isEmpty():
        raise NoWorkspaceError("no workspace belongs to the selected accounts")
    return ws


def cluster_map(clusters: DataFrame, kept_clusters: DataFrame | None) -> DataFrame:
    """(cluster_id, endpoint_id) of the analysed warehouses: the customer's, not serverless."""
    c = clusters.select("cluster_id", "endpoint_id").distinct()
    if kept_clusters is None:
        return c
    kept = kept_clusters.select("cluster_id").join(clusters.select("cluster_id"), "cluster_id", "left_semi")
    return c.join(kept, "cluster_id", "left_semi")


def attributed_statements(intervals: DataFrame, clusters: DataFrame, kept_clusters: DataFrame | None = None) -> DataFrame:
    """Single-customer statements with their endpoint.

    ``clusters``: (cluster_id, endpoint_id) of the customer; ``kept_clusters``:
    cluster ids that are not serverless.  The keep-list is an existence test
    (left-semi join), so a cluster created several times does not repeat its
    statements; the (large) lifecycle log is first cut to the customer's
    clusters.  The statement keeps its own workspace id.  Spark broadcasts the
    cluster list into the statement join when it is small; a stored one (the plans
    write it) has a known size, so the statements are then not shuffled.  With a
    bucketed log (``sources.layout``) and its salted map, bucket meets bucket at any size.
    """
    if "salt" in intervals.columns and "salt" in clusters.columns:
        joined = intervals.join(clusters.hint("shuffle_hash"), ["cluster_id", "salt"])
    else:
        joined = intervals.join(cluster_map(clusters, kept_clusters), "cluster_id")
    return joined.select(
        "statement_id", "cluster_id", "workspace_id", "endpoint_id", "start_us", "end_us", "duration_s", "fetch_s"
    )


def account_clusters(endpoints: DataFrame, accounts_ws: DataFrame) -> DataFrame:
    """(cluster_id, workspace_id, endpoint_id, customer_name) of the selected accounts' warehouses."""
    return endpoints.select("cluster_id", "workspace_id", "endpoint_id").distinct().join(
        accounts_ws.select("workspace_id", "customer_name").distinct(), "workspace_id")


def attributed_statements_region(intervals: DataFrame, clusters: DataFrame) -> DataFrame:
    """Statements of the selected accounts with endpoint and customer name (C6, region entry).

    ``clusters`` is ``account_clusters(...)``: the mapping of the selected
    accounts, joined on cluster and workspace.  With a bucketed log and its salted map,
    bucket meets bucket, and the workspace is compared afterwards: as a key of the join
    it would ask for another distribution than the buckets'.
    """
    if "salt" in intervals.columns and "salt" in clusters.columns:
        m = clusters.withColumnRenamed("workspace_id", "_of").hint("shuffle_hash")
        joined = intervals.join(m, ["cluster_id", "salt"]).where(F.array_contains(F.array("_of"), F.col("workspace_id")))
    else:
        m = clusters.select("cluster_id", "workspace_id", "endpoint_id", "customer_name")
        joined = intervals.join(m, ["cluster_id", "workspace_id"])
    return (
        joined
        .select("statement_id", "cluster_id", "workspace_id", "endpoint_id", "customer_name",
                "start_us", "end_us", "duration_s", "fetch_s")
    )


def active_span(statements: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """First start and last end per warehouse (C7): the always-on cluster's up time."""
    if keys is None:
        keys = [c for c in ("cluster_id", "endpoint_id", "workspace_id", "customer_name") if c in statements.columns]
    return statements.groupBy(*keys).agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
