"""The streaming sessions equal the batch sessions that the final watermark has closed."""

import inspect
import tempfile

from conftest import SF_SMALL
from idlecost.operators.sessions import idle_sessions
from idlecost.streaming import start_session_stream, streaming_cluster_sessions, streaming_idle_sessions

import __spark_entry__ as se


def test_streaming_sessions_match_batch(spark):
    base = tempfile.mkdtemp(prefix="idlecost-stream-")
    src = f"{base}/statements"
    att = se._all_warehouses(spark, SF_SMALL).select("cluster_id", "endpoint_id", "workspace_id", "start_us", "end_us")
    # arrival in time order: four files written one after the other, each a later stretch of the month
    lo, hi = att.agg({"start_us": "min"}).first()[0], att.agg({"start_us": "max"}).first()[0] + 1
    cuts = [lo + (hi - lo) * i // 4 for i in range(5)]
    for a, b in zip(cuts, cuts[1:]):
        att.filter((att.start_us >= a) & (att.start_us < b)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(att.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = start_session_stream(streaming_idle_sessions(stream, 1800, watermark="2 hours"), f"{base}/out",
                             f"{base}/ckpt", trigger={"availableNow": True})
    q.awaitTermination(300)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{base}/out").collect())
    assert got, "no session was emitted"
    batch = idle_sessions(spark.read.parquet(src), 1800, "cluster")
    cols = ["cluster_id", "endpoint_id", "workspace_id", "date", "start_us", "end_us", "end_autostop_us", "statements"]
    want = {tuple(r) for r in batch.select(*cols).collect()}
    got_sel = {tuple(r) for r in spark.read.parquet(f"{base}/out").select(*cols).collect()}
    # every emitted session is exactly a batch session ...
    assert got_sel <= want
    # ... and every batch session that ended well before the last start was emitted
    last_start = max(w[4] for w in want)
    closed = {w for w in want if w[6] < last_start - 2 * 3600 * 1_000_000}
    assert closed <= got_sel


def _two_endpoints(spark):
    """Each cluster serves two endpoints in turn, so that sessions of a cluster span both."""
    att = se._all_warehouses(spark, SF_SMALL).select("cluster_id", "workspace_id", "start_us", "end_us")
    return att.withColumn("endpoint_id", att.cluster_id * 2 + (att.start_us % 2)).select(
        "cluster_id", "endpoint_id", "workspace_id", "start_us", "end_us")


def test_stream_keyed_by_cluster_matches_batch_with_two_endpoints(spark):
    base = tempfile.mkdtemp(prefix="idlecost-stream-")
    att = _two_endpoints(spark)
    lo, hi = att.agg({"start_us": "min"}).first()[0], att.agg({"start_us": "max"}).first()[0] + 1
    cuts = [lo + (hi - lo) * i // 4 for i in range(5)]
    for a, b in zip(cuts, cuts[1:]):
        att.filter((att.start_us >= a) & (att.start_us < b)).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stop = 7200
    stream = spark.readStream.schema(att.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    q = start_session_stream(streaming_cluster_sessions(stream, stop, "2 hours"), f"{base}/out", f"{base}/ckpt", trigger={"availableNow": True})
    q.awaitTermination(300)
    cols = ["cluster_id", "endpoint_id", "workspace_id", "date", "start_us", "end_us", "end_autostop_us", "statements"]
    got = [tuple(r) for r in spark.read.parquet(f"{base}/out").select(*cols).collect()]
    want = {tuple(r) for r in idle_sessions(spark.read.parquet(f"{base}/in"), stop, "cluster").select(*cols).collect()}
    assert len(got) == len(set(got)) and set(got) <= want
    last_start = max(w[4] for w in want)
    whole = {w[0]: max(x[6] for x in want if x[0] == w[0] and x[4] <= w[6]) for w in want}
    closed = {w for w in want if w[6] + stop * 1_000_000 < last_start - 2 * 3600 * 1_000_000}
    assert closed and closed <= set(got) and whole
    # the window form, keyed by endpoint, too, splits sessions that the other endpoint keeps alive
    by_key = {tuple(r) for r in idle_sessions(spark.read.parquet(f"{base}/in"), stop, "cluster").select("cluster_id", "start_us").collect()}
    assert len(by_key) > 1


def test_cluster_state_merges_out_of_order_and_across_endpoints():
    import pandas as pd

    from idlecost.streaming.cluster_sessions import merged

    rows = pd.DataFrame({"cluster_id": 1, "endpoint_id": [5, 6, 5, 6], "start_us": [100, 0, 30, 500], "end_us": [110, 20, 60, 510], "statements": [1, 2, 3, 4]})
    got = merged(rows, ["cluster_id", "endpoint_id"], 40)
    assert [tuple(r) for r in got.itertuples(index=False)] == [(1, 1, 5, 30, 110, 4), (1, 1, 6, 0, 20, 2), (2, 1, 6, 500, 510, 4)]
    apart = merged(rows, ["cluster_id", "endpoint_id"], 39)
    assert apart["_session"].tolist() == [1, 1, 2, 3]
    assert merged(got.drop(columns="_session"), ["cluster_id", "endpoint_id"], 40).equals(got)


def _stream(spark, arrivals, watermark):
    """Sessions of statements that arrive one file each, in the given order."""
    import time

    base = tempfile.mkdtemp(prefix="idlecost-stream-")
    from helpers import intervals_df

    for rows in arrivals:
        intervals_df(spark, rows).coalesce(1).write.mode("append").parquet(f"{base}/in")
        time.sleep(0.05)  # the source takes files in order of their time
    schema = intervals_df(spark, []).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    q = start_session_stream(streaming_idle_sessions(stream, 1800, watermark, ["cluster_id"]), f"{base}/out", f"{base}/ckpt",
                             trigger={"availableNow": True})
    q.awaitTermination(300)
    from helpers import T0, US

    return sorted((r.cluster_id, (r.start_us - T0) // US, (r.end_us - T0) // US) for r in spark.read.parquet(f"{base}/out").collect())


def test_arrival_at_the_end_of_a_long_statement(spark):
    """10:00-10:05 and 10:20-12:05 are one session though the second arrives after other clusters' later starts."""
    minute = 60
    arrivals = [[(1, 600 * minute, 605 * minute)], [(2, 660 * minute, 661 * minute)], [(2, 720 * minute, 721 * minute)],
                [(1, 620 * minute, 725 * minute)], [(3, 2000 * minute, 2001 * minute)], [(3, 2100 * minute, 2101 * minute)]]
    want = (1, 600 * minute, 725 * minute)
    assert want in _stream(spark, arrivals, "3 hours")
    assert want not in _stream(spark, arrivals, "10 minutes")  # shorter than the longest statement: split


def test_watermark_has_no_default():
    assert inspect.signature(streaming_idle_sessions).parameters["watermark"].default is inspect.Parameter.empty
