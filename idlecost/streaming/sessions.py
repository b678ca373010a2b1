"""Idle-gap sessions on a statement stream (cluster scope).

Each statement opens a session window ``[start, end + auto_stop)`` (a per-row
gap: its own duration plus the time-out), so two statements share a session
when the later one starts no more than ``auto_stop`` after the earlier one
ended -- the batch rule of ``operators.sessions``.  Spark's ``session_window``
merges the windows per key in the state store; with a watermark on the start
time a session is emitted once (append mode) after the watermark passes its end.

The watermark has no default, as a wrong one gives wrong sessions, not only missing
rows: statements arrive when they end, so it must exceed the longest time from a
statement's start to its arrival (longest run time plus delivery delay).  With a
shorter one a long statement that would bridge two sessions comes too late and is
dropped, and they stay split.

Sessions are keyed by every ``group_by`` column (cluster, endpoint,
workspace): with the usual one-endpoint-per-cluster map this equals the batch
cluster scope.  A statement of zero length with a zero time-out has an empty
window, which ``session_window`` drops; use the batch operator for that case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idlecost.functions.time import MICROS_PER_SECOND, date_of_us, floor_to_second


def streaming_idle_sessions(
    statements: DataFrame,
    auto_stop_s: int,
    watermark: str,
    group_by: list[str] | None = None,
) -> DataFrame:
    """Streaming twin of ``idle_sessions(..., scope='cluster')``; same output columns."""
    if group_by is None:
        group_by = [c for c in ("cluster_id", "endpoint_id", "workspace_id", "customer_name")
                    if c in statements.columns]
    gap_us = F.col("end_us") - F.col("start_us") + F.lit(auto_stop_s * MICROS_PER_SECOND)
    gap = F.make_interval(secs=(gap_us.cast("decimal(20,0)") / F.lit(MICROS_PER_SECOND)).cast("decimal(18,6)"))
    s = (
        statements.withColumn("_start_ts", F.timestamp_micros("start_us"))
        .withWatermark("_start_ts", watermark)
        .groupBy(*group_by, F.session_window("_start_ts", gap).alias("_w"))
        .agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"),
             F.count(F.lit(1)).alias("statements"))
    )
    return s.select(
        *group_by,
        date_of_us("start_us").alias("date"),
        "start_us",
        "end_us",
        (floor_to_second("end_us") + F.lit(auto_stop_s * MICROS_PER_SECOND)).alias("end_autostop_us"),
        "statements",
    )


def start_session_stream(
    sessions: DataFrame,
    path: str,
    checkpoint_location: str,
    fmt: str = "parquet",
    trigger: dict | None = None,
):
    """Write the sessions in append mode to ``path``; the checkpoint belongs in shared storage."""
    writer = (
        sessions.writeStream.outputMode("append")
        .format(fmt)
        .option("path", path)
        .option("checkpointLocation", checkpoint_location)
    )
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()
