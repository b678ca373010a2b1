"""Logical input tables and the columns each operator needs.

Column names are neutral; ids may be any equality-comparable type (the fixtures
use bigint, production logs often use strings).  Files are read with these schemas, so
no job infers them; columns that a file has beyond them are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

STATEMENTS = T.StructType([
    T.StructField("statement_id", T.LongType()),
    T.StructField("cluster_id", T.LongType()),
    T.StructField("workspace_id", T.LongType()),
    T.StructField("date", T.DateType()),            # date of ended_at
    T.StructField("ended_at", T.TimestampType()),   # end of the statement
    T.StructField("duration_s", T.DoubleType()),    # run time
    T.StructField("fetch_s", T.DoubleType()),       # result fetch time, nullable
    T.StructField("status", T.StringType()),        # 'finish' for completed statements
])

ENDPOINTS = T.StructType([
    T.StructField("cluster_id", T.LongType()),
    T.StructField("endpoint_id", T.LongType()),
    T.StructField("workspace_id", T.LongType()),
])

CLUSTER_EVENTS = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("metric", T.StringType()),
    # keys: 'action', 'cluster_id', 'is_serverless' ('true' / 'false' / absent)
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
])

WORKSPACES = T.StructType([
    T.StructField("workspace_id", T.LongType()),
    T.StructField("customer_name", T.StringType()),
])

BILLING = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("account_name", T.StringType()),
    T.StructField("sales_region", T.StringType()),
    T.StructField("sku", T.StringType()),
    T.StructField("dbus", T.DoubleType()),
])

WORKLOADS = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("cluster_id", T.LongType()),
    T.StructField("node_hours", T.DoubleType()),
    T.StructField("pricing_units", T.LongType()),
    T.StructField("workers", T.LongType()),          # nullable: counts as 1 machine, null DBUs
    T.StructField("is_spot", T.BooleanType()),       # nullable: counts as on-demand
    T.StructField("region", T.StringType()),         # nullable: priced as us-east-1
    T.StructField("driver_node_type", T.StringType()),
    T.StructField("worker_node_type", T.StringType()),
])

SCHEMAS = {
    "statements": STATEMENTS,
    "endpoints": ENDPOINTS,
    "cluster_events": CLUSTER_EVENTS,
    "workspaces": WORKSPACES,
    "billing": BILLING,
    "workloads": WORKLOADS,
}

# Inputs an analysis can do without.  Prices: a row holds from ``valid_from`` (null: always) until the
# next row of the same region, option and node type; without these inputs the price book of the code holds.
VM_PRICES = T.StructType([
    T.StructField("region", T.StringType()),
    T.StructField("option", T.StringType()),         # 'ondemand' or 'spot'
    T.StructField("node_type", T.StringType()),
    T.StructField("usd_per_hour", T.DoubleType()),   # null: no longer priced
    T.StructField("valid_from", T.DateType()),
])
DBU_PRICES = T.StructType([
    T.StructField("region", T.StringType()),
    T.StructField("usd_per_dbu", T.DoubleType()),
    T.StructField("valid_from", T.DateType()),
])
OPTIONAL: dict[str, T.StructType] = {"vm_prices": VM_PRICES, "dbu_prices": DBU_PRICES}

ID_COLUMNS = ("statement_id", "cluster_id", "endpoint_id", "workspace_id")


def declared(table: str, id_type: str = "bigint") -> T.StructType:
    """The schema of a logical table with ids of ``id_type``."""
    ids = T.StructType.fromDDL(f"id {id_type}")["id"].dataType
    return T.StructType([T.StructField(f.name, ids) if f.name in ID_COLUMNS else f for f in ({**SCHEMAS, **OPTIONAL})[table].fields])


def require_columns(df: DataFrame, table: str, columns: list[str] | None = None) -> DataFrame:
    """Raise a clear error if ``df`` lacks a column the operators read from ``table``."""
    wanted = columns if columns is not None else ({**SCHEMAS, **OPTIONAL})[table].fieldNames()
    have = {c.lower() for c in df.columns}
    missing = [c for c in wanted if c.lower() not in have]
    if missing:
        raise ValueError(f"{table}: missing column(s) {missing}; has {df.columns}")
    return df
