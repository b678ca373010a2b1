"""Prices with dates: tables of price rows become periods that usage meets as of its date.

A row of ``vm_prices`` or ``dbu_prices`` (``sources.schemas``) holds from its ``valid_from``
until the next row for the same thing.  Prices of a node type and the default pairs of the
regions become rows with [valid_from, valid_to), one a change, so that an as-of look-up is an
equi-join with a range condition; Spark broadcasts these tables where their size allows it.

A region counts as priced from its first price on.  Its default pair is the price book's
rule (a name with a dash gets the first pair); a region must price its default pair, or
machines of types without a price there get no cost.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from idlecost.sources.price_book import DEFAULT_PAIR_DASHED, DEFAULT_PAIR_OTHER

ALWAYS, FOREVER = "0001-01-01", "9999-12-31"


class PriceTables(NamedTuple):
    """regions (region, since); nodes (region, node_type, on_demand_usd, spot_usd, valid_from, valid_to);
    defaults (region, the default pair's four prices, valid_from, valid_to)."""

    regions: DataFrame
    nodes: DataFrame
    defaults: DataFrame


def _from(column: str = "valid_from"):
    return F.coalesce(F.col(column), F.lit(ALWAYS).cast("date"))


def periods(prices: DataFrame, keys: list[str]) -> DataFrame:
    """``prices`` with [valid_from, valid_to) of each row; of rows of one day for one thing the dearest holds."""
    price = [c for c in prices.columns if c not in (*keys, "valid_from")]
    one = prices.withColumn("valid_from", _from()).groupBy(*keys, "valid_from").agg(*[F.max(c).alias(c) for c in price])
    following = F.lead("valid_from").over(Window.partitionBy(*keys).orderBy("valid_from"))
    return one.withColumn("valid_to", F.coalesce(following, F.lit(FOREVER).cast("date")))


def node_periods(vm_prices: DataFrame) -> DataFrame:
    """Both options' prices of a node type side by side, a row whenever either changes."""
    keys = ["region", "node_type"]
    option = {o: F.max(F.when(F.col("option") == o, F.struct("usd_per_hour"))) for o in ("ondemand", "spot")}
    changes = vm_prices.withColumn("valid_from", _from()).groupBy(*keys, "valid_from").agg(
        option["ondemand"].alias("_od"), option["spot"].alias("_sp"))
    # A change of one option leaves the other's last price (the structs tell no change from no price).
    upto = Window.partitionBy(*keys).orderBy("valid_from").rowsBetween(Window.unboundedPreceding, 0)
    held = {n: F.last(c, ignorenulls=True).over(upto).getField("usd_per_hour") for n, c in (("on_demand_usd", "_od"), ("spot_usd", "_sp"))}
    return periods(changes.select(*keys, "valid_from", *[c.alias(n) for n, c in held.items()]), keys)


def price_tables(vm_prices: DataFrame) -> PriceTables:
    nodes = node_periods(vm_prices)
    regions = vm_prices.groupBy("region").agg(F.min(_from()).alias("since"))
    dashed = F.col("region").contains("-")

    def default(place: int, name: str) -> DataFrame:
        node = F.when(dashed, DEFAULT_PAIR_DASHED[place]).otherwise(DEFAULT_PAIR_OTHER[place])
        return nodes.where(F.col("node_type") == node).select(
            "region", F.col("on_demand_usd").alias(f"default_{name}_on_demand_usd"), F.col("spot_usd").alias(f"default_{name}_spot_usd"),
            F.col("valid_from").alias(f"_{name}_from"), F.col("valid_to").alias(f"_{name}_to"))

    pair = default(0, "driver").join(default(1, "worker"), "region")
    begin, end = F.greatest("_driver_from", "_worker_from"), F.least("_driver_to", "_worker_to")
    pair = pair.withColumns({"valid_from": begin, "valid_to": end}).where("valid_from < valid_to")
    return PriceTables(regions, nodes, pair.drop("_driver_from", "_driver_to", "_worker_from", "_worker_to"))


def dbu_periods(dbu_prices: DataFrame) -> DataFrame:
    return periods(dbu_prices.select("region", "usd_per_dbu", "valid_from"), ["region"])
