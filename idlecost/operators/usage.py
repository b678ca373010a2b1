"""Machine usage per day: always-on (C10) and on-demand."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idlecost.functions.time import MICROS_PER_SECOND, floor_to_second, hours_between, seconds_to_us
from idlecost.operators.intervals import day_slices
from idlecost.sources.schemas import require_columns

WAREHOUSE_KEYS = ("cluster_id", "endpoint_id", "workspace_id", "customer_name")
NODE_KEYS = ["driver_node_type", "worker_node_type", "region"]


def _keys(df: DataFrame) -> list[str]:
    return [c for c in WAREHOUSE_KEYS if c in df.columns]


def daily_workloads(workloads: DataFrame, end_date: dt.date | None = None, start_date: dt.date | None = None) -> DataFrame:
    """The largest node hours, price units and worker count, and any spot use, of each
    (date, cluster, node types, region): all that the joins with slices and sessions need.

    Every day joined with is the day of a statement start, which is never after
    ``end_date``, the range's last day, nor before ``start_date``, the first day of the
    analysed sessions where that is known: exact bounds that reach the scan.
    """
    columns = ["date", "cluster_id", "node_hours", "pricing_units", "workers", "is_spot", *NODE_KEYS]
    have = [c for c in columns if c != "is_spot" or c in workloads.columns]
    require_columns(workloads, "workloads", have)
    w = workloads.select(*have)
    if end_date is not None:
        w = w.filter(F.col("date") <= F.lit(end_date))
    if start_date is not None:
        w = w.filter(F.col("date") >= F.lit(start_date))
    aggs = [F.max("node_hours").alias("node_hours"), F.max("pricing_units").alias("max_pricing_units"),
            F.max("workers").alias("max_workers")]
    if "is_spot" in have:
        aggs.append(F.bool_or("is_spot").alias("is_spot"))
    return w.groupBy("date", "cluster_id", *NODE_KEYS).agg(*aggs)


def _run_end_us(start_us: str, node_hours: str) -> F.Column:
    """Slice start (floored to the second) plus the day's node hours."""
    return floor_to_second(start_us) + seconds_to_us(F.col(node_hours) * F.lit(3600))


def _span_slices(spans: DataFrame, days: list[dt.date] | None) -> tuple[DataFrame, list[str]]:
    """The spans' day slices; of ``days`` only, with the day kept as ``span_date``, where they are given."""
    slices = day_slices(spans)
    if days is None:
        return slices, []
    return slices.where(F.col("date").isin(days)).withColumn("span_date", F.col("date")), ["span_date"]


def always_on_daily(spans: DataFrame, daily: DataFrame, days: list[dt.date] | None = None) -> DataFrame:
    """Always-on usage per day, single-customer form.

    The warehouse's active span (one row a warehouse) is cut at midnights; each day
    slice meets its cluster's ``daily_workloads`` of that day; the machines run from
    the slice start for the largest node hours (the run end grows with them), and the
    run is cut at midnights again: its hours are whole seconds between the slice
    bounds.  ``is_spot`` is true if any row of the group ran on spot.  ``days``: only the
    slices of these days of the spans, which ``span_date`` then tells.
    """
    slices, kept = _span_slices(spans, days)
    runs = slices.join(daily, ["date", "cluster_id"]).select(
        "date", *kept, *_keys(spans), *NODE_KEYS, "start_us", _run_end_us("start_us", "node_hours").alias("end_us"),
        "max_pricing_units", "max_workers", "is_spot")
    return day_slices(runs, extra={"node_hours": hours_between("start_us", "end_us")})


def always_on_daily_region(spans: DataFrame, daily: DataFrame, days: list[dt.date] | None = None) -> DataFrame:
    """Always-on usage per day, per-region form (C10): hours are the day's largest node hours."""
    slices, kept = _span_slices(spans, days)
    return slices.join(daily, ["date", "cluster_id"]).select(
        "date", *kept, *_keys(spans), *NODE_KEYS, "start_us", "end_us", _run_end_us("start_us", "node_hours").alias("run_end_us"),
        "node_hours", "max_pricing_units", "max_workers")


def on_demand_usage(sessions: DataFrame, daily: DataFrame) -> DataFrame:
    """On-demand DBUs of each session.

    A session meets the ``daily_workloads`` of its cluster on the day it starts; per
    region the largest price units and worker count give the DBU rate, charged
    for the whole seconds from session start to its auto-stop.
    """
    rates = daily.groupBy("date", "cluster_id", "region").agg(
        F.max("max_pricing_units").alias("max_pricing_units"), F.max("max_workers").alias("max_workers"))
    usage = sessions.join(rates, ["date", "cluster_id"]).select(
        "date", *_keys(sessions), "region", "start_us", "end_autostop_us", "max_pricing_units", "max_workers")
    seconds = ((floor_to_second("end_autostop_us") - floor_to_second("start_us")) / F.lit(MICROS_PER_SECOND)).cast("long")
    rate = (F.col("max_pricing_units") + F.col("max_workers") * F.lit(2)) / F.lit(3600)
    return usage.select("*", (rate * seconds).alias("dbus"))
