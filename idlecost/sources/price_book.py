"""Price book: on-demand DBU prices per region and hourly VM prices.

Kept as small DataFrames that are broadcast into the cost joins; their size is
fixed by the tables below, so the broadcast is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from idlecost.sources.tables import local_table

# ---------------------------------------------------------------------------
# These must equal the original analysis for equal results.
# ---------------------------------------------------------------------------

# On-demand ("serverless") price of one DBU in dollars, by region.
ON_DEMAND_DBU_USD = [
    ("us-east-1", 0.70),
    ("us-east-2", 0.70),
    ("us-west-2", 0.70),
    ("eu-central-1", 0.91),
    ("eu-west-1", 0.91),
    ("ap-southeast-2", 0.95),
    ("eastus", 0.70),
    ("eastus2", 0.70),
    ("westus", 0.70),
    ("westeurope", 0.91),
    ("northeurope", 0.91),
]

# Hourly VM list price in dollars for the single-customer analysis:
# (region, option, node type, $/hour), option 'ondemand' or 'spot'.
CUSTOMER_VM_USD = [
    ("westeurope", "ondemand", "Standard_E8ds_v4", 0.692),
    ("westeurope", "ondemand", "Standard_E16ds_v4", 1.384),
    ("westeurope", "ondemand", "Standard_E32ds_v4", 2.768),
    ("westeurope", "ondemand", "Standard_E64ds_v4", 5.536),
    ("westeurope", "spot", "Standard_E8ds_v4", 0.1025),
    ("westeurope", "spot", "Standard_E16ds_v4", 0.205),
    ("westeurope", "spot", "Standard_E32ds_v4", 0.4099),
    ("westeurope", "spot", "Standard_E64ds_v4", 0.8199),
    ("northeurope", "ondemand", "Standard_E8ds_v4", 0.64),
    ("northeurope", "ondemand", "Standard_E16ds_v4", 1.28),
    ("northeurope", "ondemand", "Standard_E32ds_v4", 2.56),
    ("northeurope", "ondemand", "Standard_E64ds_v4", 5.12),
    ("northeurope", "spot", "Standard_E8ds_v4", 0.2179),
    ("northeurope", "spot", "Standard_E16ds_v4", 0.4358),
    ("northeurope", "spot", "Standard_E32ds_v4", 0.8717),
    ("northeurope", "spot", "Standard_E64ds_v4", 1.7434),
    ("westus", "ondemand", "Standard_E8ds_v4", 0.648),
    ("westus", "ondemand", "Standard_E16ds_v4", 1.296),
    ("westus", "ondemand", "Standard_E32ds_v4", 2.592),
    ("westus", "ondemand", "Standard_E64ds_v4", 5.184),
    ("westus", "spot", "Standard_E8ds_v4", 0.0734),
    ("westus", "spot", "Standard_E16ds_v4", 0.1467),
    ("westus", "spot", "Standard_E32ds_v4", 0.2934),
    ("westus", "spot", "Standard_E64ds_v4", 0.5868),
    ("eastus2", "ondemand", "Standard_E8ds_v4", 0.576),
    ("eastus2", "ondemand", "Standard_E16ds_v4", 1.134),
    ("eastus2", "ondemand", "Standard_E32ds_v4", 2.268),
    ("eastus2", "ondemand", "Standard_E64ds_v4", 4.608),
    ("eastus2", "spot", "Standard_E8ds_v4", 0.2303),
    ("eastus2", "spot", "Standard_E16ds_v4", 0.4607),
    ("eastus2", "spot", "Standard_E32ds_v4", 0.9214),
    ("eastus2", "spot", "Standard_E64ds_v4", 1.8427),
    ("eastus", "ondemand", "Standard_E8ds_v4", 0.576),
    ("eastus", "ondemand", "Standard_E16ds_v4", 1.134),
    ("eastus", "ondemand", "Standard_E32ds_v4", 2.268),
    ("eastus", "ondemand", "Standard_E64ds_v4", 4.608),
    ("eastus", "spot", "Standard_E8ds_v4", 0.2303),
    ("eastus", "spot", "Standard_E16ds_v4", 0.4606),
    ("eastus", "spot", "Standard_E32ds_v4", 0.9211),
    ("eastus", "spot", "Standard_E64ds_v4", 1.8423),
    ("us-east-1", "ondemand", "i3.2xlarge", 0.624),
    ("us-east-1", "ondemand", "i3.4xlarge", 1.248),
    ("us-east-1", "ondemand", "i3.8xlarge", 2.496),
    ("us-east-1", "ondemand", "i3.16xlarge", 4.992),
    ("us-east-1", "spot", "i3.2xlarge", 0.26832),
    ("us-east-1", "spot", "i3.4xlarge", 0.53664),
    ("us-east-1", "spot", "i3.8xlarge", 0.7488),
    ("us-east-1", "spot", "i3.16xlarge", 1.54752),
    ("us-east-2", "ondemand", "i3.2xlarge", 0.624),
    ("us-east-2", "ondemand", "i3.4xlarge", 1.248),
    ("us-east-2", "ondemand", "i3.8xlarge", 2.496),
    ("us-east-2", "ondemand", "i3.16xlarge", 4.992),
    ("us-east-2", "spot", "i3.2xlarge", 0.1872),
    ("us-east-2", "spot", "i3.4xlarge", 0.3744),
    ("us-east-2", "spot", "i3.8xlarge", 0.7488),
    ("us-east-2", "spot", "i3.16xlarge", 1.4976),
    ("us-west-2", "ondemand", "i3.2xlarge", 0.624),
    ("us-west-2", "ondemand", "i3.4xlarge", 1.248),
    ("us-west-2", "ondemand", "i3.8xlarge", 2.496),
    ("us-west-2", "ondemand", "i3.16xlarge", 4.992),
    ("us-west-2", "spot", "i3.2xlarge", 0.2496),
    ("us-west-2", "spot", "i3.4xlarge", 0.47424),
    ("us-west-2", "spot", "i3.8xlarge", 0.92352),
    ("us-west-2", "spot", "i3.16xlarge", 1.69728),
    ("eu-central-1", "ondemand", "i3.2xlarge", 0.744),
    ("eu-central-1", "ondemand", "i3.4xlarge", 1.488),
    ("eu-central-1", "ondemand", "i3.8xlarge", 2.976),
    ("eu-central-1", "ondemand", "i3.16xlarge", 5.952),
    ("eu-central-1", "spot", "i3.2xlarge", 0.27528),
    ("eu-central-1", "spot", "i3.4xlarge", 0.5208),
    ("eu-central-1", "spot", "i3.8xlarge", 0.8928),
    ("eu-central-1", "spot", "i3.16xlarge", 1.7856),
    ("eu-west-1", "ondemand", "i3.2xlarge", 0.688),
    ("eu-west-1", "ondemand", "i3.4xlarge", 1.376),
    ("eu-west-1", "ondemand", "i3.8xlarge", 2.752),
    ("eu-west-1", "ondemand", "i3.16xlarge", 5.504),
    ("eu-west-1", "spot", "i3.2xlarge", 0.28896),
    ("eu-west-1", "spot", "i3.4xlarge", 0.50912),
    ("eu-west-1", "spot", "i3.8xlarge", 0.8256),
    ("eu-west-1", "spot", "i3.16xlarge", 1.6512),
    ("ap-southeast-2", "ondemand", "i3.2xlarge", 0.748),
    ("ap-southeast-2", "ondemand", "i3.4xlarge", 1.496),
    ("ap-southeast-2", "ondemand", "i3.8xlarge", 2.992),
    ("ap-southeast-2", "ondemand", "i3.16xlarge", 5.984),
    ("ap-southeast-2", "spot", "i3.2xlarge", 0.24684),
    ("ap-southeast-2", "spot", "i3.4xlarge", 0.50864),
    ("ap-southeast-2", "spot", "i3.8xlarge", 1.0472),
    ("ap-southeast-2", "spot", "i3.16xlarge", 1.7952),]

# The per-region analysis prices on-demand machines only.  Its book is the
# 'ondemand' part of the table above plus these Azure v3 node types.
REGION_EXTRA_VM_USD = [
    ("westeurope", "ondemand", "Standard_E8_v3", 0.640),
    ("westeurope", "ondemand", "Standard_E16_v3", 1.280),
    ("westeurope", "ondemand", "Standard_E32_v3", 2.560),
    ("westeurope", "ondemand", "Standard_E64_v3", 4.376),
    ("northeurope", "ondemand", "Standard_E8_v3", 0.564),
    ("northeurope", "ondemand", "Standard_E16_v3", 1.128),
    ("northeurope", "ondemand", "Standard_E32_v3", 2.256),
    ("northeurope", "ondemand", "Standard_E64_v3", 4.061),
    ("westus", "ondemand", "Standard_E8_v3", 0.560),
    ("westus", "ondemand", "Standard_E16_v3", 1.120),
    ("westus", "ondemand", "Standard_E32_v3", 2.240),
    ("westus", "ondemand", "Standard_E64_v3", 4.032),
    ("eastus2", "ondemand", "Standard_E8_v3", 0.532),
    ("eastus2", "ondemand", "Standard_E16_v3", 1.064),
    ("eastus2", "ondemand", "Standard_E32_v3", 2.128),
    ("eastus2", "ondemand", "Standard_E64_v3", 3.629),
    ("eastus", "ondemand", "Standard_E8_v3", 0.504),
    ("eastus", "ondemand", "Standard_E16_v3", 1.008),
    ("eastus", "ondemand", "Standard_E32_v3", 2.016),
    ("eastus", "ondemand", "Standard_E64_v3", 3.629),
]

# Region used for machines whose region is missing or not in the book.
FALLBACK_REGION = "us-east-1"
# Node pair assumed when the driver type is not in the book: regions whose name
# contains '-' (AWS style) get the first pair, the others (Azure style) the second.
DEFAULT_PAIR_DASHED = ("i3.8xlarge", "i3.2xlarge")
DEFAULT_PAIR_OTHER = ("Standard_E32ds_v4", "Standard_E8ds_v4")

# ---------------------------------------------------------------------------

BOOKS = ("customer", "region")


def vm_price_rows(book: str) -> list[tuple[str, str, str, float]]:
    """Long form (region, option, node_type, usd_per_hour) of one VM book."""
    if book == "customer":
        return list(CUSTOMER_VM_USD)
    if book == "region":
        return [r for r in CUSTOMER_VM_USD if r[1] == "ondemand"] + list(REGION_EXTRA_VM_USD)
    raise ValueError(f"unknown price book {book!r}; expected one of {BOOKS}")


def vm_price_wide_rows(book: str) -> list[tuple[str, str, float | None, float | None]]:
    """(region, node_type, on_demand_usd, spot_usd): one row per priced node type."""
    wide: dict[tuple[str, str], list[float | None]] = {}
    for region, option, node, usd in vm_price_rows(book):
        slot = wide.setdefault((region, node), [None, None])
        slot[0 if option == "ondemand" else 1] = usd
    return [(r, n, p[0], p[1]) for (r, n), p in wide.items()]


def book_regions(book: str = "customer") -> list[str]:
    seen: dict[str, None] = {}
    for region, *_ in vm_price_rows(book):
        seen.setdefault(region)
    return list(seen)


def default_pair(region: str) -> tuple[str, str]:
    return DEFAULT_PAIR_DASHED if "-" in region else DEFAULT_PAIR_OTHER


def region_default_rows(book: str) -> list[tuple[str, float | None, float | None, float | None, float | None]]:
    """(region, default driver on-demand/spot $, default worker on-demand/spot $) per book region."""
    prices = {(r, n): (od, sp) for r, n, od, sp in vm_price_wide_rows(book)}
    out = []
    for region in book_regions(book):
        driver, worker = default_pair(region)
        d, w = prices[(region, driver)], prices[(region, worker)]
        out.append((region, d[0], d[1], w[0], w[1]))
    return out


DBU_SCHEMA = T.StructType([
    T.StructField("region", T.StringType(), False),
    T.StructField("usd_per_dbu", T.DoubleType(), False),
])
VM_LONG_SCHEMA = T.StructType([
    T.StructField("region", T.StringType(), False),
    T.StructField("option", T.StringType(), False),
    T.StructField("node_type", T.StringType(), False),
    T.StructField("usd_per_hour", T.DoubleType(), False),
])
VM_WIDE_SCHEMA = T.StructType([
    T.StructField("region", T.StringType(), False),
    T.StructField("node_type", T.StringType(), False),
    T.StructField("on_demand_usd", T.DoubleType(), True),
    T.StructField("spot_usd", T.DoubleType(), True),
])
DEFAULTS_SCHEMA = T.StructType([
    T.StructField("region", T.StringType(), False),
    T.StructField("default_driver_on_demand_usd", T.DoubleType(), True),
    T.StructField("default_driver_spot_usd", T.DoubleType(), True),
    T.StructField("default_worker_on_demand_usd", T.DoubleType(), True),
    T.StructField("default_worker_spot_usd", T.DoubleType(), True),
])


def dbu_prices(spark: SparkSession) -> DataFrame:
    return local_table(spark, ON_DEMAND_DBU_USD, DBU_SCHEMA)


def vm_prices(spark: SparkSession, book: str = "customer") -> DataFrame:
    """Long form of a VM book: (region, option, node_type, usd_per_hour)."""
    return local_table(spark, vm_price_rows(book), VM_LONG_SCHEMA)


def vm_prices_wide(spark: SparkSession, book: str = "customer") -> DataFrame:
    return local_table(spark, vm_price_wide_rows(book), VM_WIDE_SCHEMA)


def region_defaults(spark: SparkSession, book: str = "customer") -> DataFrame:
    return local_table(spark, region_default_rows(book), DEFAULTS_SCHEMA)
