"""The six logical inputs derived from the driver's test tables (see FIXTURES.md).

Every expression here has a DuckDB twin in ``idlecost.oracle_sql`` so that the
same logical tables exist on both sides of the correctness check.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idlecost.config import TcoParams
from idlecost.session import shared_dir
from idlecost.sources import price_book as pb
from idlecost.sources.layout import layout_of, write_statement_log
from idlecost.sources.schemas import DBU_PRICES, SCHEMAS, VM_PRICES
from idlecost.sources.tables import Inputs, local_table

# Fixed values of the fixture derivation (FIXTURES.md).
# Every HOT_EVERY-th statement runs on cluster 0, the others on their user's.
HOT_EVERY = 4
USERS_PER_CLUSTER, USERS_PER_ENDPOINT, USERS_PER_WORKSPACE = 2, 4, 8
CUSTOMERS_PER_ACCOUNT = 80
LIFECYCLE_METRIC = "lifecycle"
CREATE_ACTIONS = ("create", "create_from_pool")
FIXTURE_REGIONS = [
    "us-east-1", "us-east-2", "us-west-2", "eu-central-1", "eu-west-1", "ap-southeast-2",
    "eastus", "eastus2", "westus", "westeurope", "northeurope", "sa-east-1",
]  # user_id % 13 = 0..11; 12 -> null
AZURE_DRIVERS = ["Standard_E32ds_v4", "Standard_E8_v3", "Standard_D99"]   # by event_id % 3
AWS_DRIVERS = ["i3.8xlarge", "i3.4xlarge", "m9.large"]                     # by event_id % 3
AZURE_WORKER = "Standard_E8ds_v4"
AWS_WORKER = "i3.2xlarge"
SQL_PRIORITIES = ["1-URGENT", "2-HIGH"]


#: The columns of the driver's tables that the fixtures read.
TABLES = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int",
    "orders": "o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "nation": "n_nationkey int, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


class Tables:
    """The driver's tables of one folder: each file is opened once, with a declared schema."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self.opened: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.opened:
            self.opened[name] = self.spark.read.schema(TABLES[name]).parquet(f"{self.sf_dir}/{name}.parquet")
        return self.opened[name]


def _user() -> F.Column:
    """The user an event counts for: user 0 for every HOT_EVERY-th event."""
    return F.when(F.col("event_id") % HOT_EVERY == 0, F.lit(0).cast("long")).otherwise(F.col("user_id"))


def _per(users: int) -> F.Column:
    """Integer division, so that cluster -> endpoint -> workspace is functional."""
    return F.call_function("div", _user(), F.lit(users)).cast("long")


def _pick(index: F.Column, values: list[str]) -> F.Column:
    expr = F.lit(None).cast("string")
    for i in reversed(range(len(values))):
        expr = F.when(index == i, F.lit(values[i])).otherwise(expr)
    return expr


def statements(tables: Tables) -> DataFrame:
    ev = tables["events"]
    return ev.select(
        F.col("event_id").alias("statement_id"),
        _per(USERS_PER_CLUSTER).alias("cluster_id"),
        _per(USERS_PER_WORKSPACE).alias("workspace_id"),
        F.col("ts").cast("date").alias("date"),
        F.col("ts").cast("timestamp").alias("ended_at"),
        F.col("value").alias("duration_s"),
        F.when(F.col("event_id") % 4 == 0, F.lit(None).cast("int"))
        .otherwise(F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
        .alias("fetch_s"),
        F.when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit("finish")).alias("status"),
    )


def endpoints(tables: Tables) -> DataFrame:
    ev = tables["events"]
    return ev.select(
        _per(USERS_PER_CLUSTER).alias("cluster_id"),
        _per(USERS_PER_ENDPOINT).alias("endpoint_id"),
        _per(USERS_PER_WORKSPACE).alias("workspace_id"),
    ).distinct()


def cluster_events(tables: Tables) -> DataFrame:
    users = tables["events"].select("user_id").distinct()
    uid = F.col("user_id")
    cluster = F.call_function("div", uid, F.lit(USERS_PER_CLUSTER)).cast("long")
    action = (
        F.when(uid % 5 == 4, F.lit("resize"))
        .when(uid % 2 == 0, F.lit(CREATE_ACTIONS[0]))
        .otherwise(F.lit(CREATE_ACTIONS[1]))
    )
    serverless = (
        F.when(cluster % 12 == 7, F.lit("true"))
        .when(uid % 3 == 0, F.lit(None).cast("string"))
        .otherwise(F.lit("false"))
    )
    return users.select(
        uid,
        F.date_add(F.lit("2024-01-01").cast("date"), (uid % 31).cast("int")).alias("date"),
        F.lit(LIFECYCLE_METRIC).alias("metric"),
        F.create_map(
            F.lit("action"), action,
            F.lit("cluster_id"), cluster.cast("string"),
            F.lit("is_serverless"), serverless,
        ).alias("tags"),
    )


def workspaces(tables: Tables) -> DataFrame:
    c = tables["customer"]
    return c.select(
        F.col("c_custkey").alias("workspace_id"),
        F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("customer_name"),
    )


def billing(tables: Tables) -> DataFrame:
    o = tables["orders"].alias("o")
    c = tables["customer"].alias("c")
    n = tables["nation"].alias("n")
    r = tables["region"].alias("r")
    a = tables["customer"].alias("a")
    payer = F.call_function("div", F.col("o.o_custkey"), F.lit(CUSTOMERS_PER_ACCOUNT)).cast("long")
    j = (
        o.join(c, F.col("o.o_custkey") == F.col("c.c_custkey"))
        .join(n, F.col("c.c_nationkey") == F.col("n.n_nationkey"))
        .join(r, F.col("n.n_regionkey") == F.col("r.r_regionkey"))
        .join(a, F.col("a.c_custkey") == payer)
    )
    return j.select(
        F.col("o.o_orderdate").cast("date").alias("date"),
        F.lower(F.col("a.c_name")).alias("account_name"),
        F.col("r.r_name").alias("sales_region"),
        F.when(F.col("o.o_orderpriority").isin(*SQL_PRIORITIES), F.lit("PREMIUM_SQL_COMPUTE"))
        .otherwise(F.lit("JOBS_COMPUTE")).alias("sku"),
        F.col("o.o_totalprice").alias("dbus"),
    )


def workloads(tables: Tables) -> DataFrame:
    ev = tables["events"]
    uid, eid = F.col("user_id"), F.col("event_id")
    azure = (uid % 13).between(6, 10)
    return ev.select(
        F.col("ts").cast("date").alias("date"),
        _per(USERS_PER_CLUSTER).alias("cluster_id"),
        (F.col("value") / 5).alias("node_hours"),
        (1 + eid % 16).alias("pricing_units"),
        F.when(eid % 5 == 0, F.lit(None).cast("long")).otherwise(eid % 5).alias("workers"),
        (uid % 3 == 0).alias("is_spot"),
        _pick(uid % 13, FIXTURE_REGIONS).alias("region"),
        F.when(azure, _pick(eid % 3, AZURE_DRIVERS)).otherwise(_pick(eid % 3, AWS_DRIVERS)).alias("driver_node_type"),
        F.when(azure, F.lit(AZURE_WORKER)).otherwise(F.lit(AWS_WORKER)).alias("worker_node_type"),
    )


# Fixed values of the price tables: the price book's prices always, dearer ones from a day on, and a
# region that the book lacks, priced like another from a day on.
PRICE_CHANGE, PRICE_FACTOR = dt.date(2024, 1, 16), 1.1
NEW_REGION, NEW_REGION_FROM, LIKE_REGION, NEW_REGION_FACTOR = "sa-east-1", dt.date(2024, 1, 10), "us-east-1", 1.25


def vm_price_rows() -> list[tuple]:
    """Rows of ``vm_prices``: on-demand prices change, spot prices stay."""
    book = [(*r, None) for r in pb.vm_price_rows("customer")]
    dearer = [(r, o, n, usd * PRICE_FACTOR, PRICE_CHANGE) for r, o, n, usd, _ in book if o == "ondemand"]
    new = [(NEW_REGION, o, n, usd * NEW_REGION_FACTOR, NEW_REGION_FROM) for r, o, n, usd, _ in book if r == LIKE_REGION]
    return book + dearer + new


def dbu_price_rows() -> list[tuple]:
    book = [(*r, None) for r in pb.ON_DEMAND_DBU_USD]
    return book + [(r, usd * PRICE_FACTOR, PRICE_CHANGE) for r, usd, _ in book] + [(NEW_REGION, 0.95, NEW_REGION_FROM)]


def load_fixture_inputs(spark: SparkSession, sf_dir: str, with_prices: bool = False) -> Inputs:
    """The six logical inputs over ``sf_dir`` (and price tables): a query opens the files of the inputs that it reads."""
    tables = Tables(spark, sf_dir)
    makers = (statements, endpoints, cluster_events, workspaces, workloads, billing)
    sources = {make.__name__: (lambda make=make: make(tables)) for make in makers}
    if with_prices:
        sources |= {"vm_prices": lambda: local_table(spark, vm_price_rows(), VM_PRICES),
                    "dbu_prices": lambda: local_table(spark, dbu_price_rows(), DBU_PRICES)}
    return Inputs(spark, sources, id_type="bigint")


def bucketed_fixture_inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    """The same with the statements written as a bucketed table (``sources.layout``)."""
    fixture = load_fixture_inputs(spark, sf_dir)
    table = f"idlecost_statements_{uuid.uuid4().hex}"
    write_statement_log(fixture.statements, table, int(spark.conf.get("spark.sql.shuffle.partitions")), f"{shared_dir(spark)}/{table}")
    sources = {name: (lambda name=name: fixture.table(name)) for name in SCHEMAS}
    return Inputs(spark, sources | {"statements": lambda: spark.table(table)}, "bigint", lambda: layout_of(spark, table))


#: Parameters of the registered queries (FIXTURES.md); the statement log and the billing have their own ranges.
CUSTOMER_PARAMS = TcoParams(
    start_date="2024-01-01", end_date="2024-01-30", customer_name="customer#000000000",
    lifecycle_metric=LIFECYCLE_METRIC, create_actions=CREATE_ACTIONS)
REGION_PARAMS = TcoParams(
    start_date="2024-01-01", end_date="2024-01-30", sales_region="A", top_accounts=4,
    billing_start_date="1995-01-01", billing_end_date="1998-12-31", only_finished=False)
GLOBAL_SESSION_AUTO_STOP_S = 60
