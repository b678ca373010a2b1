"""Day-by-day runs of an analysis: resumable sessions, and only the days rewritten that a new day changes.

``run(first_day, last_day)`` reads the statements of the new days only.  Their sessions are merged
with the stored sessions that they can touch, those ending no earlier than the auto-stop time before
the first new start; a long statement may so join sessions of many days.

State, below ``<out>/state``: each run writes the session partitions (by start day) that it
changes as a version of its own, ``sessions/run=<last day>/date=<day>``, never over an older one;
``held/run=`` says for every day which run holds it and the latest end of its sessions;
``spans/run=`` holds one row a warehouse, its first start and last end.  A row in ``commits``, written last, makes
a run valid.  So a run that was lost on the way is simply run again, the latest run may be
repeated, and no statement is counted twice.  Older versions can be deleted once no
``held`` of a valid run names them.

Published tables, below ``<out>``: ``sessions`` and ``on_demand_costs`` by ``date``,
``always_on_costs`` by ``span_date`` (the day of the warehouse's active span that a row prices; its
run may reach into later days).  A run replaces the partitions of the days it changes by dynamic
partition overwrite; days that lost all rows are emptied.

Days are the only thing collected: lists of changed days, a row a day of history in ``held``.
The lifecycle log, billing and mapping are read for the range of the analysis' parameters, as
in one run over all of it; the result equals that run's.
"""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idlecost import operators as op
from idlecost.functions.time import MICROS_PER_SECOND, day_number
from idlecost.plans.customer import CustomerAnalysis
from idlecost.plans.region import KEYS, RegionAnalysis
from idlecost.session import stored


class Held(NamedTuple):
    """Where the sessions of a day are, and their latest end."""

    run: str
    max_end_us: int


class Changes(NamedTuple):
    """The days that a run changes: of sessions, and of warehouses' active spans."""

    run: str
    session_days: list[dt.date]
    span_days: list[dt.date]


class DailyRuns:
    def __init__(self, analysis: CustomerAnalysis | RegionAnalysis, out_dir: str, fmt: str = "parquet"):
        if analysis.params.session_scope != "cluster":
            raise ValueError("day-by-day runs need sessions of cluster scope")
        self.analysis, self.fmt = analysis, fmt
        self.spark = analysis.inputs.spark
        self.out = out_dir.rstrip("/")
        self.state = f"{self.out}/state"

    # -- state -----------------------------------------------------------------
    def runs(self) -> list[str]:
        """The valid runs by their last day, in order."""
        try:
            rows = self.spark.read.schema("run string").parquet(f"{self.state}/commits").distinct().collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(r[0] for r in rows)

    def _held(self, run: str | None) -> dict[dt.date, Held]:
        if run is None:
            return {}
        rows = self.spark.read.schema("date date, run string, max_end_us long").parquet(f"{self.state}/held/run={run}").collect()
        return {r["date"]: Held(r["run"], r["max_end_us"]) for r in rows}

    def _sessions_held(self, held: dict[dt.date, Held], like: DataFrame) -> DataFrame:
        """The stored sessions of the days in ``held``: a scan of exactly these partitions."""
        if not held:
            return like.where(F.lit(False))
        of_run: dict[str, list[dt.date]] = {}
        for day, at in held.items():
            of_run.setdefault(at.run, []).append(day)
        wanted = F.lit(False)
        for run, days in of_run.items():
            wanted = wanted | ((F.col("run") == run) & F.col("date").isin(days))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields)
        return self.spark.read.schema(f"{schema}, run string").parquet(f"{self.state}/sessions").where(wanted).select(*like.columns)

    def sessions(self) -> DataFrame:
        """All sessions up to the latest valid run."""
        runs = self.runs()
        return self._sessions_held(self._held(runs[-1] if runs else None), self._no_sessions())

    def _no_sessions(self) -> DataFrame:
        ids = self.analysis.statements.schema
        times = [T.StructField(c, T.LongType()) for c in ("start_us", "end_us", "end_autostop_us", "statements")]
        schema = [*[ids[k] for k in KEYS if k in ids.names], T.StructField("date", T.DateType()), *times]
        return self.spark.createDataFrame([], T.StructType(schema))

    def _spans(self, run: str) -> DataFrame:
        return self.spark.read.schema(self.analysis.active_span.schema).parquet(f"{self.state}/spans/run={run}")

    # -- a run -------------------------------------------------------------------
    def run(self, first_day: dt.date, last_day: dt.date | None = None) -> Changes:
        """Take in the statements of the new days and publish what they change."""
        changes = self.advance(first_day, last_day)
        self.publish(changes)
        return changes

    def advance(self, first_day: dt.date, last_day: dt.date | None = None) -> Changes:
        """Take in the statements of the new days: write this run's state and make it valid."""
        last_day = last_day or first_day
        run = last_day.isoformat()
        runs = self.runs()
        before = max((r for r in runs if r < run), default=None)
        if (runs and run < runs[-1]) or (before and first_day.isoformat() <= before):
            raise ValueError(f"days come in order, each once: the latest run ends {runs[-1]}, this one begins {first_day}")
        a, p = self.analysis, self.analysis.params
        intervals = op.statement_intervals(a.inputs.statements, first_day, last_day, p.only_finished)
        fresh = stored(op.idle_sessions(a.statements_of(intervals), p.auto_stop_s, "cluster", bucket_s=p.session_bucket_s), "new-sessions")
        keys = [c for c in KEYS if c in fresh.columns]
        lowest, first = fresh.agg(F.min("start_us"), F.min("date")).first()
        held = self._held(before)
        changed: list[dt.date] = []
        if lowest is not None:
            reach = lowest - p.auto_stop_s * MICROS_PER_SECOND
            touched = {day: at for day, at in held.items() if at.max_end_us >= reach or day >= first}
            merged = op.resume_sessions(self._sessions_held(touched, fresh), fresh, p.auto_stop_s, keys, p.session_bucket_s)
            merged.select(*fresh.columns).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("date").parquet(
                f"{self.state}/sessions/run={run}")
            written = self.spark.read.schema(fresh.schema).parquet(f"{self.state}/sessions/run={run}")
            ends = {r[0]: Held(run, r[1]) for r in written.groupBy("date").agg(F.max("end_us")).collect()}
            held = {day: at for day, at in held.items() if day not in touched} | ends
            changed = sorted({*touched, *ends})
        span_days = self._advance_spans(op.active_span(fresh.select(*keys, "start_us", "end_us"), keys), before, run, keys)
        self.spark.createDataFrame([(d, *at) for d, at in sorted(held.items())], "date date, run string, max_end_us long").write.mode(
            "overwrite").parquet(f"{self.state}/held/run={run}")
        self.spark.createDataFrame([(run,)], "run string").write.mode("append").parquet(f"{self.state}/commits")
        return Changes(run, changed, span_days)

    def _advance_spans(self, fresh: DataFrame, before: str | None, run: str, keys: list[str]) -> list[dt.date]:
        """Write the warehouses' spans of this run; the days on which a span has grown."""
        old = self._spans(before) if before else fresh.where(F.lit(False))
        bounds = [F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")]
        old.unionByName(fresh).groupBy(*keys).agg(*bounds).write.mode("overwrite").parquet(f"{self.state}/spans/run={run}")
        was = old.select(*keys, F.col("start_us").alias("_start"), F.col("end_us").alias("_end"))
        now = self._spans(run).join(was, keys, "left")

        def days(begin, end):
            return F.sequence(day_number(begin), day_number(F.greatest(begin, end - 1)))

        none = F.array().cast("array<bigint>")
        grown = F.concat(
            F.when(F.col("_start").isNull(), days(F.col("start_us"), F.col("end_us"))).otherwise(none),
            F.when(F.col("start_us") < F.col("_start"), days(F.col("start_us"), F.col("_start") + 1)).otherwise(none),
            F.when(F.col("end_us") > F.col("_end"), days(F.greatest("start_us", F.col("_end") - 1), F.col("end_us"))).otherwise(none))
        rows = now.select(F.explode(grown).alias("_day")).distinct().select(F.date_from_unix_date(F.col("_day").cast("int"))).collect()
        return sorted(r[0] for r in rows)

    # -- published tables ----------------------------------------------------------
    def publish(self, changes: Changes) -> None:
        """Replace the changed days of the published tables; publishing again gives the same."""
        a, held = self.analysis, self._held(changes.run)
        if changes.session_days:
            sessions = self._sessions_held({d: held[d] for d in changes.session_days if d in held}, self._no_sessions())
            self._put("sessions", sessions, "date", changes.session_days)
            self._put("on_demand_costs", a.on_demand_costs_of(sessions, changes.session_days[0]), "date", changes.session_days)
        if changes.span_days:
            self._put("always_on_costs", a.always_on_costs_on(self._spans(changes.run), changes.span_days), "span_date", changes.span_days)

    def _put(self, name: str, rows: DataFrame, by: str, days: list[dt.date]) -> None:
        path = f"{self.out}/{name}"
        rows = stored(rows, name)
        have = {r[0] for r in rows.select(by).distinct().collect()}
        if have:
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).format(self.fmt).save(path)
        for day in days:
            if day not in have:  # dynamic overwrite leaves a partition without new rows as it was
                rows.where(F.lit(False)).drop(by).write.mode("overwrite").format(self.fmt).save(f"{path}/{by}={day}")

    def published(self, name: str) -> DataFrame:
        return self.spark.read.format(self.fmt).load(f"{self.out}/{name}")

    def reports(self) -> dict[str, DataFrame]:
        """Every total and timeline, from the published tables."""
        return self.analysis.totals(*[self.published(n) for n in ("sessions", "always_on_costs", "on_demand_costs")])
