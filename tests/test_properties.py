"""Property tests: sessions and day slices on random intervals."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from helpers import US, idle_sessions_plain, intervals_df
from idlecost import operators as op

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

interval = st.tuples(
    st.integers(min_value=1, max_value=3),          # cluster
    st.integers(min_value=0, max_value=3 * 86400),  # start second
    st.integers(min_value=0, max_value=20000),      # duration seconds
)
interval_lists = st.lists(interval, min_size=1, max_size=40)


def _rows(items):
    return [(c, s, s + d) for c, s, d in items]


def _tuples(df):
    return sorted(tuple(r) for r in df.select("cluster_id", "start_us", "end_us", "statements").collect())


@SETTINGS
@given(items=interval_lists, gap=st.one_of(st.integers(min_value=0, max_value=9), st.integers(min_value=0, max_value=5000)),
       bucket=st.sampled_from([1, 60, 900, 86400]), scope=st.sampled_from(["cluster", "global"]))
def test_bucketed_sessions_equal_plain_window(spark, items, gap, bucket, scope):
    df = intervals_df(spark, _rows(items))
    got = op.idle_sessions(df, gap, scope, group_by=["cluster_id"], bucket_s=bucket)
    part = ["cluster_id"] if scope == "cluster" else []
    want = idle_sessions_plain(df, gap * US, part, ["cluster_id"])
    assert _tuples(got) == _tuples(want)


@SETTINGS
@given(items=interval_lists, gap=st.integers(min_value=0, max_value=5000))
def test_sessions_cover_disjoint_and_apart(spark, items, gap):
    rows = _rows(items)
    s = _tuples(op.idle_sessions(intervals_df(spark, rows), gap, group_by=["cluster_id"], bucket_s=600))
    assert sum(x[3] for x in s) == len(rows)                      # every statement in one session
    by_cluster = {}
    for c, a, b, _ in s:
        by_cluster.setdefault(c, []).append((a, b))
    for spans in by_cluster.values():
        spans.sort()
        for (a1, b1), (a2, b2) in zip(spans, spans[1:]):
            assert a2 - gap * US > b1                              # strictly more than the gap apart
    more = op.idle_sessions(intervals_df(spark, rows), gap + 1000, group_by=["cluster_id"], bucket_s=600).count()
    assert more <= len(s)                                          # a longer time-out never adds sessions


@SETTINGS
@given(items=interval_lists)
def test_day_slices_sum_to_interval(spark, items):
    rows = _rows(items)
    df = intervals_df(spark, [(i, s, e) for i, (_, s, e) in enumerate(rows)])
    sl = op.day_slices(df).collect()
    total = {}
    for r in sl:
        assert r.start_us <= r.end_us
        assert (r.start_us // (86400 * US)) == (r.end_us - 1) // (86400 * US) or r.start_us == r.end_us
        total[r.cluster_id] = total.get(r.cluster_id, 0) + (r.end_us - r.start_us)
    assert total == {i: (e - s) * US for i, (_, s, e) in enumerate(rows)}
