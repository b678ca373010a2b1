"""Timeline segments (C20): per-day time-of-day bars of statements, sessions or runs.

The original drew these with a plotting library after collecting to the
driver; here the segments are a distributed DataFrame any plotting or BI tool
can read.  Offsets are microseconds from the day's midnight; the display
strings put every day on 1970-01-01 so days line up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idlecost.functions.time import day_start_us, time_of_day_display
from idlecost.operators.intervals import day_slices


def timeline_segments(
    df: DataFrame,
    start: str = "start_us",
    end: str = "end_us",
    keys: list[str] | None = None,
) -> DataFrame:
    """One row per (interval, day it touches): date, keys, offsets and display strings."""
    if keys is None:
        keys = [c for c in ("endpoint_id", "cluster_id", "workspace_id", "customer_name") if c in df.columns]
    base = df.select(*keys, F.col(start).alias("start_us"), F.col(end).alias("end_us"))
    sl = day_slices(base)
    midnight = day_start_us(F.unix_date(F.col("date")))
    start_off = F.col("start_us") - midnight
    end_off = F.col("end_us") - midnight
    return sl.select(
        "date",
        *keys,
        start_off.alias("start_offset_us"),
        end_off.alias("end_offset_us"),
        time_of_day_display(start_off).alias("start_display"),
        time_of_day_display(end_off).alias("end_display"),
    )
