"""Idle-gap sessions on a statement stream, keyed by cluster alone.

``streaming_idle_sessions`` lets Spark's ``session_window`` merge windows, keyed by cluster,
endpoint and workspace: where a cluster serves two endpoints, each endpoint's statements end
their own sessions.  Here the state of a cluster holds its open sessions itself, split by endpoint and
workspace, so that any statement of the cluster keeps all of them alive, as in the batch operator
``idle_sessions(scope="cluster")``.

State: the rows (keys, first start, last end, statements) of the cluster's open sessions, as
Arrow bytes.  New statements are merged with them batch by batch.  A session is closed when the watermark
(on start times) has reached its end plus the auto-stop time: statements that come later
start after that.  Then its rows go out and leave the state; a timer on the event time wakes
a cluster without new statements.  State so holds open sessions only, however many statements they have.

A cluster's statements of one micro-batch meet in one task, in Arrow batches that are merged one by one:
memory follows the open sessions, time the statements.  The watermark has no default, as in
``streaming_idle_sessions``: it must exceed the longest time from a statement's start to its arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from idlecost.functions.time import MICROS_PER_DAY, MICROS_PER_SECOND

_MILLI = 1_000


def merged(rows: pd.DataFrame, keys: list[str], gap_us: int) -> pd.DataFrame:
    """``rows`` (keys, start_us, end_us, statements) of one cluster, one row a session and keys; ``_session`` numbers the sessions."""
    rows = rows.sort_values("start_us", kind="stable")
    start, end = rows["start_us"].to_numpy(), rows["end_us"].to_numpy()
    before = np.maximum.accumulate(end)[:-1]
    opens = np.append(True, start[1:] - gap_us > before) if len(rows) else np.zeros(0, dtype=bool)
    return rows.assign(_session=np.cumsum(opens)).groupby(["_session", *keys], as_index=False, dropna=False, sort=True).agg(
        start_us=("start_us", "min"), end_us=("end_us", "max"), statements=("statements", "sum"))


def _to_bytes(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _from_bytes(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


def _on_cluster(keys: list[str], auto_stop_s: int):
    gap = auto_stop_s * MICROS_PER_SECOND
    columns = [*keys, "start_us", "end_us", "statements"]

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _from_bytes(state.get[0]) if state.exists else None
        for frame in frames:
            if len(frame):
                frame = frame.assign(statements=np.int64(1))[columns]
                held = merged(frame if held is None else pd.concat([held, frame]), keys, gap)[columns]
        if held is None or not len(held):
            return
        watermark = state.getCurrentWatermarkMs() * _MILLI
        rows = merged(held, keys, gap)
        closes = rows.groupby("_session")["end_us"].transform("max") + gap
        closed = (closes <= watermark).to_numpy()
        left = rows[~closed]
        if len(left):
            state.update((_to_bytes(left[columns]),))
            # The first whole millisecond by which a session is closed; it lies after the watermark.
            state.setTimeoutTimestamp(int(-(-int(closes[~closed].min()) // _MILLI)))
        elif state.exists:
            state.remove()
        if closed.any():
            out = rows[closed]
            yield pd.DataFrame({k: out[k] for k in keys} | {
                "date": pd.to_datetime(out["start_us"] // MICROS_PER_DAY, unit="D").dt.date, "start_us": out["start_us"], "end_us": out["end_us"],
                "end_autostop_us": out["end_us"] // MICROS_PER_SECOND * MICROS_PER_SECOND + gap, "statements": out["statements"]})
    return run


def streaming_cluster_sessions(statements: DataFrame, auto_stop_s: int, watermark: str, group_by: list[str] | None = None) -> DataFrame:
    """Streaming twin of ``idle_sessions(..., scope='cluster')`` for any map of clusters to endpoints; same columns."""
    keys = group_by or [c for c in ("cluster_id", "endpoint_id", "workspace_id", "customer_name") if c in statements.columns]
    rows = statements.where("cluster_id IS NOT NULL AND start_us IS NOT NULL AND end_us IS NOT NULL").select(
        *keys, "start_us", "end_us", F.timestamp_micros("start_us").alias("_start_ts")).withWatermark("_start_ts", watermark)
    long = T.LongType()
    out = T.StructType([*[rows.schema[k] for k in keys], T.StructField("date", T.DateType()), T.StructField("start_us", long),
                        T.StructField("end_us", long), T.StructField("end_autostop_us", long), T.StructField("statements", long)])
    state = T.StructType([T.StructField("open", T.BinaryType())])
    return rows.groupBy("cluster_id").applyInPandasWithState(_on_cluster(keys, auto_stop_s), out, state, "append", GroupStateTimeout.EventTimeTimeout)
