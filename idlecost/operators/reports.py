"""Totals and comparisons.

``cost_totals`` holds the totals of every level, made in one pass over both cost tables;
``reports_of_totals`` takes each report from it.  The single reports below do the same from
the costs themselves.

Totals are exact (summed in millionths of a dollar), so they do not depend on
partitioning or row order.  Sorting is optional: it is a presentation step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idlecost.functions.money import from_micros, sum_usd, to_micros


def _sorted(df: DataFrame, by: str, sort: bool) -> DataFrame:
    return df.orderBy(F.col(by).asc_nulls_first()) if sort else df


def always_on_by_endpoint(costs: DataFrame, sort: bool = True) -> DataFrame:
    """Always-on dollars per endpoint: total, DBU, VM on-demand, VM spot."""
    out = costs.groupBy("endpoint_id").agg(
        sum_usd("total_usd").alias("always_on_usd"),
        sum_usd("dbu_usd").alias("dbu_usd"),
        sum_usd("vm_on_demand_usd").alias("vm_on_demand_usd"),
        sum_usd("vm_spot_usd").alias("vm_spot_usd"),
    )
    return _sorted(out, "always_on_usd", sort)


def on_demand_by_endpoint(costs: DataFrame, sort: bool = True) -> DataFrame:
    """On-demand dollars per endpoint."""
    out = costs.groupBy("endpoint_id").agg(sum_usd("on_demand_usd").alias("on_demand_usd"))
    return _sorted(out, "on_demand_usd", sort)


def always_on_by_customer(costs: DataFrame, sort: bool = True) -> DataFrame:
    """Always-on dollars per customer: total, DBU, VM."""
    out = costs.groupBy("customer_name").agg(
        sum_usd("total_usd").alias("always_on_usd"),
        sum_usd("dbu_usd").alias("dbu_usd"),
        sum_usd("vm_usd").alias("vm_usd"),
    )
    return _sorted(out, "always_on_usd", sort)


def on_demand_by_customer(costs: DataFrame, sort: bool = True) -> DataFrame:
    """On-demand dollars per customer."""
    out = costs.groupBy("customer_name").agg(sum_usd("on_demand_usd").alias("on_demand_usd"))
    return _sorted(out, "on_demand_usd", sort)


def grand_totals(always_on_costs: DataFrame, on_demand_costs: DataFrame) -> DataFrame:
    """One row: every total over all endpoints, both sides (C17).

    The two sides are stacked (union) and aggregated once; no join is needed.
    """
    null = F.lit(None).cast("long")
    ao = always_on_costs.select(
        to_micros("total_usd").alias("a"), to_micros("dbu_usd").alias("d"),
        to_micros("vm_on_demand_usd").alias("o"), to_micros("vm_spot_usd").alias("s"), null.alias("n"))
    od = on_demand_costs.select(null.alias("a"), null.alias("d"), null.alias("o"), null.alias("s"),
                                to_micros("on_demand_usd").alias("n"))
    return ao.unionByName(od).agg(
        from_micros(F.sum("a")).alias("always_on_usd"),
        from_micros(F.sum("d")).alias("dbu_usd"),
        from_micros(F.sum("o")).alias("vm_on_demand_usd"),
        from_micros(F.sum("s")).alias("vm_spot_usd"),
        from_micros(F.sum("n")).alias("on_demand_usd"),
    )


def cost_comparison(on_demand: DataFrame, always_on: DataFrame) -> DataFrame:
    """Per customer: on-demand minus always-on DBU dollars, minus always-on total, and in percent.

    Customers present on one side only are left out (inner join).  The percent
    is null when the always-on total is zero.
    """
    od = on_demand.select("customer_name", "on_demand_usd")
    ao = always_on.select("customer_name", "always_on_usd", "dbu_usd", "vm_usd")
    return _compared(od.join(ao, "customer_name"))


def _compared(both: DataFrame) -> DataFrame:
    variation = F.col("on_demand_usd") - F.col("always_on_usd")
    return both.select(
        "customer_name",
        "on_demand_usd",
        "always_on_usd",
        "dbu_usd",
        "vm_usd",
        (F.col("on_demand_usd") - F.col("dbu_usd")).alias("team_variation_usd"),
        variation.alias("variation_usd"),
        F.when(F.col("always_on_usd") != 0, variation / F.col("always_on_usd") * F.lit(100)).alias("variation_pct"),
    )


def cost_comparison_daily(always_on_costs: DataFrame, on_demand_costs: DataFrame) -> DataFrame:
    """Per day and cluster: always-on against on-demand dollars.

    Each side is aggregated to (date, cluster_id) first, so the join is
    one-to-one and both sides arrive hash-partitioned on the join keys.
    """
    ao = always_on_costs.groupBy("date", "cluster_id").agg(
        sum_usd("total_usd").alias("always_on_usd"),
        sum_usd("dbu_usd").alias("always_on_dbu_usd"),
        from_micros(F.sum(to_micros(F.col("vm_on_demand_usd") + F.col("vm_spot_usd")))).alias("always_on_vm_usd"),
    )
    od = on_demand_costs.groupBy("date", "cluster_id").agg(
        sum_usd("dbus").alias("on_demand_dbus"),
        sum_usd("on_demand_usd").alias("on_demand_usd"),
    )
    return ao.join(od, ["date", "cluster_id"]).withColumn(
        "variation_usd", F.col("on_demand_usd") - F.col("always_on_usd")
    )


#: The levels of ``cost_totals`` and their keys; a level applies where the costs have its keys.
LEVELS = {"all": (), "endpoint": ("endpoint_id",), "customer": ("customer_name",), "cluster_day": ("date", "cluster_id")}
_ALWAYS_ON = ("always_on_usd", "dbu_usd", "vm_on_demand_usd", "vm_spot_usd", "vm_usd")
_ON_DEMAND = ("on_demand_dbus", "on_demand_usd")


def cost_totals(always_on_costs: DataFrame, on_demand_costs: DataFrame) -> DataFrame:
    """Both sides' totals at every level, by grouping sets.

    Columns: ``level``, the keys of all levels (null where a level doesn't have them),
    the rows of each side, and the totals; machine dollars of the region form have no
    on-demand and spot columns, so these are null there.  The sides are stacked and
    added up by all keys first, exactly (whole millionths), so only these sums are
    repeated for the grouping sets, however many levels there are.
    """
    levels = {n: k for n, k in LEVELS.items() if set(k) <= set(always_on_costs.columns) & set(on_demand_costs.columns)}
    keys = list(dict.fromkeys(k for ks in levels.values() for k in ks))
    split = "vm_on_demand_usd" in always_on_costs.columns
    vm = F.col("vm_on_demand_usd") + F.col("vm_spot_usd") if split else F.col("vm_usd")
    amounts = {"always_on_usd": F.col("total_usd"), "dbu_usd": F.col("dbu_usd"), "vm_usd": vm}
    if split:
        amounts |= {c: F.col(c) for c in ("vm_on_demand_usd", "vm_spot_usd")}
    none = F.lit(None).cast("long")

    def side(costs: DataFrame, own: dict[str, Column], name: str) -> DataFrame:
        counts = [F.lit(int(name == n)).cast("long").alias(f"{n}_rows") for n in ("always_on", "on_demand")]
        return costs.select(*keys, *counts, *[(to_micros(own[c]) if c in own else none).alias(c) for c in (*_ALWAYS_ON, *_ON_DEMAND)])

    both = side(always_on_costs, amounts, "always_on").unionByName(
        side(on_demand_costs, {"on_demand_dbus": F.col("dbus"), "on_demand_usd": F.col("on_demand_usd")}, "on_demand"))
    sums = ["always_on_rows", "on_demand_rows", *_ALWAYS_ON, *_ON_DEMAND]
    finest = both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
    sets = finest.groupingSets([[F.col(k) for k in ks] for ks in levels.values()], *keys)
    of_level = [(reduce(lambda a, b: a & b, [F.grouping(k) == int(k not in ks) for k in keys]), n) for n, ks in levels.items()]
    level = F.coalesce(*[F.when(is_it, n) for is_it, n in of_level])
    totals = sets.agg(level.alias("level"), *[F.sum(c).alias(c) for c in sums])
    return totals.select("level", *keys, *sums[:2], *[from_micros(c).alias(c) for c in sums[2:]])


def reports_of_totals(totals: DataFrame) -> dict[str, DataFrame]:
    """The reports of every level that ``cost_totals`` has, equal to the single reports below."""
    def at(level: str, *sides: str) -> DataFrame:
        return totals.where(" AND ".join([f"level = '{level}'", *[f"{s}_rows > 0" for s in sides]]))

    every = at("all").agg(*[F.max(c).alias(c) for c in (*_ALWAYS_ON, *_ON_DEMAND)])  # one row, also of nothing
    variation = F.col("on_demand_usd") - F.col("always_on_usd")
    out = {
        "grand_totals": every.select("always_on_usd", "dbu_usd", "vm_on_demand_usd", "vm_spot_usd", "on_demand_usd"),
        "always_on_by_endpoint": at("endpoint", "always_on").select("endpoint_id", "always_on_usd", "dbu_usd", "vm_on_demand_usd", "vm_spot_usd"),
        "on_demand_by_endpoint": at("endpoint", "on_demand").select("endpoint_id", "on_demand_usd"),
        "cost_comparison_daily": at("cluster_day", "always_on", "on_demand").select(
            "date", "cluster_id", "always_on_usd", F.col("dbu_usd").alias("always_on_dbu_usd"), F.col("vm_usd").alias("always_on_vm_usd"),
            "on_demand_dbus", "on_demand_usd", variation.alias("variation_usd")),
    }
    if "customer_name" in totals.columns:
        ao = at("customer", "always_on").select("customer_name", "always_on_usd", "dbu_usd", "vm_usd")
        od = at("customer", "on_demand").select("customer_name", "on_demand_usd")
        out |= {"always_on_by_customer": ao, "on_demand_by_customer": od, "cost_comparison": _compared(
            at("customer", "always_on", "on_demand").where("customer_name IS NOT NULL"))}
    return out
