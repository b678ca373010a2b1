"""Idle-gap sessions (C8): merge statements whose gap is at most the auto-stop time.

A statement opens a new session when ``start - gap > max(end of every earlier
statement)`` in start order (strict: a gap of exactly ``gap`` still merges).
The running maximum is a prefix scan, and a plain ``Window.partitionBy(cluster)
.orderBy(start)`` would put a whole cluster -- or, for the global scope, every
statement -- on one task.  Instead the scan runs over cells:

1. statements of one scope whose starts lie in one cell of width ``gap`` always
   share a session (the later start minus the gap can't exceed the earlier start,
   hence not its end).  So they are aggregated per (keys, cell) to earliest start,
   latest end and count first, with partial aggregation before the shuffle: a burst
   or a hot cluster sends one row a map task and cell;
2. the cells of a scope -- ``range / gap`` rows a cluster -- get a prefix scan: a
   cell opens a session when its earliest start minus the gap exceeds the latest end
   of all earlier cells; its session is the start of the latest opener;
3. cells of one session are aggregated.

For a time-out below ``bucket`` a scope can have a cell a statement.  The cells are then
dealt to range partitions by (scope, cell) -- sampled borders, so that a burst of a
minute or a hot cluster spreads over as many partitions as its cells need -- and stored
with the number of their partition.  The scan runs in two levels: inside each part (the
cells of one scope in one partition) a window computes the latest *local* opener; a
summary row a part (max end, last local opener) gets its own prefix scan over the parts
of its scope, at most one a partition; joined back, a cell's session is its local opener
if that one still opens against what the part's carry-in holds, else the carried one.  (True openers of
a part are a suffix of its local openers: their starts grow, so ``start - gap >
carry_in`` holds from some point on.)  Which of the two forms runs depends on the
time-out alone; results are the same (tests check both against the plain window).  Ends
are never before starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idlecost.functions.time import MICROS_PER_SECOND, date_of_us, floor_div, floor_to_second
from idlecost.session import stored

SESSION_KEY = "_session"


def _opens(start: Column, before: Column, gap: Column) -> Column:
    return before.isNull() | (start - gap > before)


def _with_session(cells: DataFrame, part: list[str], gap: Column) -> DataFrame:
    """``cells`` with their session: one prefix scan over the cells of each scope."""
    w = (Window.partitionBy(*part) if part else Window).orderBy("_cell")
    before = F.max("_e").over(w.rangeBetween(Window.unboundedPreceding, -1))
    start = F.min("_s").over(w.rangeBetween(0, 0))  # of all the cell's rows
    opener = F.when(_opens(start, before, gap), start)
    cells = cells.withColumn("_o", opener)
    return cells.withColumn(SESSION_KEY, F.max("_o").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_o")


def _range_parts(cells: DataFrame, part: list[str]) -> DataFrame:
    """``cells`` in order of scope and cell, dealt to range partitions of about equal size, with the
    partition's number.  They are stored, so that every use sees the same partitions."""
    return stored(cells.repartitionByRange(*part, "_cell").withColumn("_range", F.spark_partition_id()), "cells")


def _ranged_cell_sessions(cells: DataFrame, part: list[str], gap: Column) -> DataFrame:
    """The same in two levels: inside each scope's part of a range partition, then over one row a part."""
    bkey = [*part, "_range"]
    rows = _range_parts(cells, part)
    w = Window.partitionBy(*bkey).orderBy("_cell")
    rows = rows.select("*", F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    local = F.when(_opens(F.col("_s"), F.col("_before"), gap), F.col("_s"))
    rows = rows.select(*bkey, "_cell", "_e", F.max(local).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_lo"))

    wb = (Window.partitionBy(*part) if part else Window).orderBy("_range")
    earlier = wb.rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*bkey).agg(F.max("_e").alias("_bmax"), F.max("_lo").alias("_blo"))
    parts = parts.select(*bkey, "_blo", F.max("_bmax").over(earlier).alias("_cin"))
    part_open = F.when(_opens(F.col("_blo"), F.col("_cin"), gap), F.col("_blo"))
    carry = parts.select(*bkey, "_cin", F.max(part_open).over(earlier).alias("_copen"))
    session = F.when(_opens(F.col("_lo"), F.col("_cin"), gap), F.col("_lo")).otherwise(F.col("_copen"))
    return rows.join(carry, bkey).select(*part, "_cell", session.alias(SESSION_KEY))


def merge_sessions(
    df: DataFrame,
    gap_us: int,
    partition_by: list[str],
    group_by: list[str],
    start: str = "start_us",
    end: str = "end_us",
    bucket_us: int = 60 * MICROS_PER_SECOND,
    weight: str | None = None,
) -> DataFrame:
    """Sessions of ``df``'s intervals.

    ``partition_by``: keys that scope a session (``['cluster_id']``, or ``[]``
    for one busy period over all rows).  ``group_by``: extra columns the output
    is split by (the original analysis splits a global session per cluster, endpoint,
    workspace).  Returns ``partition_by + group_by`` columns, ``_session`` (the
    start of the statement that opened the session), ``start_us`` (earliest
    start), ``end_us`` (latest end) and ``statements``.  ``bucket_us``: time-outs below it
    take the scan over range partitions.  ``weight``: the column that says how many
    statements a row stands for (default: one).
    """
    if gap_us < 0:
        raise ValueError("gap must be >= 0")
    part = list(partition_by)
    keys = part + [g for g in group_by if g not in part]
    gap = F.lit(int(gap_us))

    cells = df.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"),
                      floor_div(F.col(start), max(int(gap_us), 1)).alias("_cell"),
                      (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"))
    # Null checks spelled out, including the ones the join below would infer
    # for one side only, so both uses of ``cells`` stay identical below the
    # shuffle and Spark runs the statement branch and its shuffle once.
    not_null = F.col("_s").isNotNull() & F.col("_e").isNotNull() & F.col("_cell").isNotNull()
    for k in part:
        not_null = not_null & F.col(k).isNotNull()
    cells = cells.filter(not_null).groupBy(*keys, "_cell").agg(
        F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.sum("_w").alias("_n"))
    if part and gap_us >= bucket_us:
        # Few cells a scope: the scan runs over the cells themselves, the statements are read once.
        cells = _with_session(cells, part, gap)
    else:
        scope = cells.groupBy(*part, "_cell").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"))
        if gap_us >= bucket_us:
            sessions = _with_session(scope, part, gap).select(*part, "_cell", SESSION_KEY)
        else:
            sessions = _ranged_cell_sessions(scope, part, gap)
        cells = cells.join(sessions, [*part, "_cell"])
    return cells.groupBy(*keys, SESSION_KEY).agg(
        F.min("_s").alias("start_us"),
        F.max("_e").alias("end_us"),
        F.sum("_n").alias("statements"),
    )


def idle_sessions(
    statements: DataFrame,
    auto_stop_s: int,
    scope: str = "cluster",
    group_by: list[str] | None = None,
    bucket_s: int = 60,
) -> DataFrame:
    """Busy sessions of attributed statements under an auto-stop time-out.

    Adds ``end_autostop_us`` (latest end floored to the second, plus the
    time-out: when the on-demand cluster would stop) and ``date`` (the day the
    session starts on; it is priced with that day's workload).
    ``scope='cluster'`` merges per cluster; ``'global'`` over all rows, split per
    ``group_by`` afterwards (the original notebooks' behaviour).
    """
    if scope not in ("cluster", "global"):
        raise ValueError("scope must be 'cluster' or 'global'")
    if group_by is None:
        group_by = [c for c in ("cluster_id", "endpoint_id", "workspace_id", "customer_name") if c in statements.columns]
    part = ["cluster_id"] if scope == "cluster" else []
    s = merge_sessions(
        statements,
        gap_us=auto_stop_s * MICROS_PER_SECOND,
        partition_by=part,
        group_by=group_by,
        bucket_us=bucket_s * MICROS_PER_SECOND,
    )
    return _timed(s, auto_stop_s)


def resume_sessions(sessions: DataFrame, more: DataFrame, auto_stop_s: int, group_by: list[str], bucket_s: int = 60) -> DataFrame:
    """The sessions of two sets of statements, from the sessions of each (cluster scope).

    A session's rows cover nothing that isn't in it, and together all that its
    statements cover, so merging sessions as intervals joins exactly those that the
    statements would have joined; statement counts add up.
    """
    columns = [*group_by, "start_us", "end_us", "statements"]
    both = sessions.select(*columns).unionByName(more.select(*columns))
    merged = merge_sessions(both, auto_stop_s * MICROS_PER_SECOND, ["cluster_id"], group_by, bucket_us=bucket_s * MICROS_PER_SECOND,
                            weight="statements")
    return _timed(merged, auto_stop_s)


def _timed(s: DataFrame, auto_stop_s: int) -> DataFrame:
    return s.select(
        *[c for c in s.columns if c not in ("start_us", "end_us", "statements", SESSION_KEY)],
        date_of_us("start_us").alias("date"),
        "start_us",
        "end_us",
        (floor_to_second("end_us") + F.lit(auto_stop_s * MICROS_PER_SECOND)).alias("end_autostop_us"),
        "statements",
    )

