"""Statement intervals (C1) and midnight cuts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idlecost.functions.time import (
    MICROS_PER_DAY,
    day_number,
    day_start_us,
    epoch_us,
    floor_to_milli,
    seconds_to_us,
)
from idlecost.sources.schemas import require_columns

#: Intervals longer than this (ten years) are taken for wrong input.
MAX_DAYS = 3660
INTERVAL_COLUMNS = ["statement_id", "cluster_id", "workspace_id", "date", "start_us", "end_us", "duration_s", "fetch_s"]


def statement_intervals(
    statements: DataFrame,
    start_date: dt.date,
    end_date: dt.date,
    only_finished: bool = True,
) -> DataFrame:
    """One row per statement of the date range with its time interval.

    ``end_us`` is the end instant; ``start_us`` is the end floored to the
    millisecond minus run time minus fetch time (a missing fetch time counts 0).
    Both are UTC epoch microseconds.  The date filter is on the raw ``date``
    column so that it reaches the scan (partition pruning / pushed filter).
    """
    require_columns(statements, "statements", ["statement_id", "cluster_id", "workspace_id", "date",
                                               "ended_at", "duration_s", "fetch_s", "status"])
    s = statements.filter(F.col("date").between(F.lit(start_date), F.lit(end_date)))
    if only_finished:
        s = s.filter(F.col("status") == F.lit("finish"))
    fetch = F.coalesce(F.col("fetch_s").cast("double"), F.lit(0.0))
    end_us = epoch_us("ended_at")
    start_us = floor_to_milli(end_us) - seconds_to_us(F.col("duration_s")) - seconds_to_us(fetch)
    return s.select(
        *[c for c in ("salt",) if c in s.columns],  # of a bucketed log (``sources.layout``)
        "statement_id",
        "cluster_id",
        "workspace_id",
        "date",
        start_us.alias("start_us"),
        end_us.alias("end_us"),
        F.col("duration_s").cast("double").alias("duration_s"),
        fetch.alias("fetch_s"),
    )


def day_slices(
    df: DataFrame,
    start: str = "start_us",
    end: str = "end_us",
    date_col: str = "date",
    extra: dict[str, F.Column] | None = None,
) -> DataFrame:
    """Cut each interval ``[start, end)`` at UTC midnights: one row per day it touches.

    ``start``/``end`` are replaced by the slice bounds and ``date_col`` is set
    to the slice's day.  Slices are half-open, so an interval that ends exactly
    at midnight gets no empty piece on the next day; a zero-length interval
    keeps one zero-length slice.  Rows without bounds are dropped, and rows that end
    before they start.  The row count grows by the number of days spanned: those of the
    date range for spans and sessions, and of a run's node hours for runs; an interval
    of more than ``MAX_DAYS`` days fails with a message.
    ``extra``: more columns computed from the slice bounds (named ``start``/``end``).
    """
    too_long = F.col(end) - F.col(start) > F.lit(MAX_DAYS * MICROS_PER_DAY)
    df = df.filter(F.col(end) >= F.col(start)).withColumn(end, F.when(too_long, F.raise_error(
        F.lit(f"an interval spans more than {MAX_DAYS} days; check its times or node hours")).cast("long")).otherwise(F.col(end)))
    first = day_number(F.col(start))
    last = day_number(F.greatest(F.col(start), F.col(end) - F.lit(1)))
    others = [c for c in df.columns if c not in (start, end, date_col)]
    exploded = df.select(*others, start, end, F.explode(F.sequence(first, last)).alias("_day"))
    day_begin = day_start_us("_day")
    cut = exploded.select(
        *others,
        F.date_from_unix_date(F.col("_day").cast("int")).alias(date_col),
        F.greatest(F.col(start), day_begin).alias(start),
        F.least(F.col(end), day_begin + F.lit(MICROS_PER_DAY)).alias(end),
    )
    if extra:
        cut = cut.select("*", *[expr.alias(name) for name, expr in extra.items()])
    return cut

