"""Prices (C11, C12, C14) as joins against the price book of the code or price tables with dates.

The book has a fixed, small size, so broadcasting it is bounded; the joins are
left joins with ``coalesce`` fall-backs, evaluated in the scan's codegen stage.  Price tables
are inputs (``sources.price_periods``): Spark chooses their joins by their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idlecost.sources import price_book as pb
from idlecost.sources.price_periods import PriceTables


def dbu_cost_always_on(daily: DataFrame, cost_per_dbu: float) -> DataFrame:
    """DBUs = (price units + 2 x workers) x hours; dollars = DBUs x price (C11).

    A missing worker count gives missing DBUs (and so a missing total).
    """
    dbus = (F.col("max_pricing_units") + F.col("max_workers") * F.lit(2)) * F.col("node_hours")
    return daily.select("*", dbus.alias("dbus"), (dbus * F.lit(float(cost_per_dbu))).alias("dbu_usd"))


def _discounted(price: Column, discount_pct: int) -> Column:
    return price * F.lit(100 - int(discount_pct)) / F.lit(100)


def _book_prices(df: DataFrame, book: str) -> DataFrame:
    """``df`` with the price columns of ``_vm_rates`` from the price book of the code."""
    spark = df.sparkSession
    regions = pb.book_regions(book)
    region_eff = F.when(F.col("region").isin(*regions), F.col("region")).otherwise(F.lit(pb.FALLBACK_REGION))
    prices = pb.vm_prices_wide(spark, book)
    drv = F.broadcast(prices.select(
        F.col("region").alias("_dr"), F.col("node_type").alias("_dn"),
        F.col("on_demand_usd").alias("_d_od"), F.col("spot_usd").alias("_d_sp")))
    wrk = F.broadcast(prices.select(
        F.col("region").alias("_wr"), F.col("node_type").alias("_wn"),
        F.col("on_demand_usd").alias("_w_od"), F.col("spot_usd").alias("_w_sp")))
    dflt = F.broadcast(pb.region_defaults(spark, book).select(
        F.col("region").alias("_fr"),
        F.col("default_driver_on_demand_usd").alias("_dd_od"), F.col("default_driver_spot_usd").alias("_dd_sp"),
        F.col("default_worker_on_demand_usd").alias("_dw_od"), F.col("default_worker_spot_usd").alias("_dw_sp")))
    x = df.withColumn("_region_eff", region_eff)
    x = x.join(drv, (F.col("_region_eff") == F.col("_dr")) & (F.col("driver_node_type") == F.col("_dn")), "left")
    x = x.join(wrk, (F.col("_region_eff") == F.col("_wr")) & (F.col("worker_node_type") == F.col("_wn")), "left")
    return x.join(dflt, F.col("_region_eff") == F.col("_fr"), "left")


def _dated_prices(df: DataFrame, prices: PriceTables) -> DataFrame:
    """The same from price tables, as of each row's date."""
    def on_date(name: str) -> Column:
        return (F.col("date") >= F.col(f"{name}_from")) & (F.col("date") < F.col(f"{name}_to"))

    def nodes(name: str) -> DataFrame:
        return prices.nodes.select(
            F.col("region").alias(f"{name}r"), F.col("node_type").alias(f"{name}n"), F.col("on_demand_usd").alias(f"{name}_od"),
            F.col("spot_usd").alias(f"{name}_sp"), F.col("valid_from").alias(f"{name}_from"), F.col("valid_to").alias(f"{name}_to"))

    regions = prices.regions.select(F.col("region").alias("_known"), "since")
    dflt = prices.defaults.select(
        F.col("region").alias("_fr"),
        F.col("default_driver_on_demand_usd").alias("_dd_od"), F.col("default_driver_spot_usd").alias("_dd_sp"),
        F.col("default_worker_on_demand_usd").alias("_dw_od"), F.col("default_worker_spot_usd").alias("_dw_sp"),
        F.col("valid_from").alias("_f_from"), F.col("valid_to").alias("_f_to"))
    x = df.join(regions, (F.col("region") == F.col("_known")) & (F.col("date") >= F.col("since")), "left")
    x = x.withColumn("_region_eff", F.coalesce("_known", F.lit(pb.FALLBACK_REGION)))
    for name, node in (("_d", "driver_node_type"), ("_w", "worker_node_type")):
        x = x.join(nodes(name), (F.col("_region_eff") == F.col(f"{name}r")) & (F.col(node) == F.col(f"{name}n")) & on_date(name), "left")
    return x.join(dflt, (F.col("_region_eff") == F.col("_fr")) & on_date("_f"), "left")


def _vm_rates(df: DataFrame, book: str | PriceTables, discount_pct: int, spot: bool) -> tuple[DataFrame, Column, Column | None]:
    """Join the prices onto ``df``; return it with the on-demand (and spot) $/hour expressions.

    Rules (per option): a region that is missing or not in the book is priced as
    ``us-east-1``; a driver type not in that region's book is replaced, together
    with the worker type, by the region's default pair; a known driver with an
    unknown worker uses the region's default worker; a missing worker count
    counts one worker.  Each price is discounted by ``discount_pct`` percent.
    ``book`` names a price book of the code or is a set of price tables with dates.
    """
    x = _book_prices(df, book) if isinstance(book, str) else _dated_prices(df, book)
    workers = F.coalesce(F.col("max_workers"), F.lit(1))

    def rate(d: str, w: str, dd: str, dw: str) -> Column:
        driver = F.coalesce(F.col(d), F.col(dd))
        worker = F.when(F.col(d).isNotNull(), F.coalesce(F.col(w), F.col(dw))).otherwise(F.col(dw))
        return _discounted(driver, discount_pct) + _discounted(worker, discount_pct) * workers

    on_demand = rate("_d_od", "_w_od", "_dd_od", "_dw_od")
    return x, on_demand, (rate("_d_sp", "_w_sp", "_dd_sp", "_dw_sp") if spot else None)


def with_vm_rates(df: DataFrame, book: str | PriceTables = "customer", discount_pct: int = 0) -> DataFrame:
    """Add ``vm_rate_on_demand`` and ``vm_rate_spot``: $/hour of the driver plus its workers."""
    x, on_demand, spot = _vm_rates(df, book, discount_pct, spot=True)
    return x.select(*df.columns, on_demand.alias("vm_rate_on_demand"), spot.alias("vm_rate_spot"))


def vm_cost(daily_with_dbu: DataFrame, discount_pct: int, book: str | PriceTables = "customer") -> DataFrame:
    """Machine dollars of always-on usage, on-demand and spot apart (C12, single customer).

    A spot row has zero on-demand cost and vice versa (missing ``is_spot`` is
    on-demand); total = VM on-demand + VM spot + DBU dollars.
    """
    x, on_demand, spot_rate = _vm_rates(daily_with_dbu, book, discount_pct, spot=True)
    spot = F.coalesce(F.col("is_spot"), F.lit(False))
    od_usd = F.when(spot, F.lit(0.0)).otherwise(on_demand) * F.col("node_hours")
    sp_usd = F.when(spot, spot_rate).otherwise(F.lit(0.0)) * F.col("node_hours")
    return x.select(
        *daily_with_dbu.columns,
        od_usd.alias("vm_on_demand_usd"),
        sp_usd.alias("vm_spot_usd"),
        (od_usd + sp_usd + F.col("dbu_usd")).alias("total_usd"),
    )


def vm_cost_region(daily_with_dbu: DataFrame, discount_pct: int, book: str | PriceTables = "region") -> DataFrame:
    """Machine dollars at on-demand prices of the per-region book (C12); total = VM + DBU dollars."""
    x, on_demand, _ = _vm_rates(daily_with_dbu, book, discount_pct, spot=False)
    vm = on_demand * F.col("node_hours")
    return x.select(*daily_with_dbu.columns, vm.alias("vm_usd"), (vm + F.col("dbu_usd")).alias("total_usd"))


def dbu_cost_on_demand(usage: DataFrame, discount_pct: int, default_price: float, prices: DataFrame | None = None) -> DataFrame:
    """On-demand dollars = DBUs x discounted regional DBU price (C14).

    A region missing from the book (or null) uses ``default_price``.  ``prices``: DBU
    prices with dates (``sources.price_periods.dbu_periods``), met as of the usage's date.
    """
    if prices is None:
        book = F.broadcast(pb.dbu_prices(usage.sparkSession).select(
            F.col("region").alias("_pr"), F.col("usd_per_dbu").alias("_p")))
        x = usage.join(book, F.col("region") == F.col("_pr"), "left")
    else:
        book = prices.select(F.col("region").alias("_pr"), F.col("usd_per_dbu").alias("_p"), "valid_from", "valid_to")
        x = usage.join(book, (F.col("region") == F.col("_pr")) & (F.col("date") >= F.col("valid_from"))
                       & (F.col("date") < F.col("valid_to")), "left")
    price = _discounted(F.coalesce(F.col("_p"), F.lit(float(default_price))), discount_pct)
    return x.select(*usage.columns, price.alias("usd_per_dbu"), (F.col("dbus") * price).alias("on_demand_usd"))
