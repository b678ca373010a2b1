"""Exact dedup and the n-gram Jaccard join against brute force."""

import random

import pytest

from idlecost.llm import exact_dedup, jaccard_join
from llm_cases import components, docs, exact, odd_rows, row_key, sentence


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=row_key)


def test_content_groups_odd_cases(spark):
    rows = odd_rows()
    assert rows_of(exact_dedup.content_groups(docs(spark, rows))) == exact(rows)


def test_content_groups_hot_group_over_many_partitions(spark):
    rng = random.Random(3)
    hot = sentence(rng, 8)
    rows = [(i, hot + " " * (i % 3)) for i in range(600)] + [(1000 + i, sentence(rng, 8)) for i in range(600)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rows_of(exact_dedup.content_groups(docs(spark, rows))) == exact(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_empty_tables(spark):
    none = docs(spark, [])
    assert rows_of(exact_dedup.content_groups(none)) == []
    assert rows_of(jaccard_join.link_components(none)) == []
    assert exact_dedup.exact_dedup(none).columns == none.columns
    assert jaccard_join.near_dedup(none).collect() == []


def test_exact_dedup_keeps_rows_whole(spark):
    rows = odd_rows()
    got = exact_dedup.exact_dedup(docs(spark, rows))
    assert got.columns == docs(spark, rows).columns
    kept = sorted((r.doc_id for r in got.collect()), key=lambda x: (x is None, x or 0))
    assert kept == sorted((e[0] for e in exact(rows) if e[3]), key=lambda x: (x is None, x or 0))


def test_components_odd_cases(spark):
    rows = odd_rows()
    assert rows_of(jaccard_join.link_components(docs(spark, rows))) == components(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_drifting_families(spark, seed):
    """Families of near copies whose members drift around the threshold, hot passages, chains."""
    rng = random.Random(seed)
    passage = sentence(rng, 30).split()
    rows, at = [], 0
    for _ in range(8):
        base = sentence(rng, rng.choice([12, 40, 90])).split()
        if rng.random() < 0.4:
            base += passage
        for _ in range(rng.choice([2, 6, 14])):
            text = list(base)
            for _ in range(rng.randrange(0, 5)):
                text[rng.randrange(len(text))] = f"e{rng.randrange(30)}"
            if rng.random() < 0.2:
                base = text  # the family drifts
            rows.append((at, " ".join(text)))
            at += 1
    rows += [(at + i, " ".join(passage + sentence(rng, k).split())) for i, k in enumerate([0, 0, 1, 2, 3, 5, 8, 13, 30])]
    rng.shuffle(rows)
    assert rows_of(jaccard_join.link_components(docs(spark, rows))) == components(rows)


def test_components_join_large_family_without_pairs(spark):
    rng = random.Random(5)
    base = sentence(rng, 120).split()
    rows = []
    for i in range(250):
        text = list(base)
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = f"z{rng.randrange(10_000)}"
        rows.append((i, " ".join(text)))
    assert rows_of(jaccard_join.link_components(docs(spark, rows))) == components(rows)


def test_components_of_links():
    from idlecost.llm.jaccard_join import _unpack, _pack
    import numpy as np

    keys, sizes, counts = np.array([5, 9], np.uint64), np.array([3, 4]), np.array([2, 1])
    tokens = np.array([1 << 20, 7 << 40, 3 << 16], np.uint64)
    got = _unpack(_pack(keys, sizes, counts, tokens, np.array([2, 3, 4])), True)
    assert [g.tolist() for g in got] == [[5, 9], [3, 4], [2, 1], tokens.tolist(), [2, 3, 4]]


def test_star_components(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    got = {(r.node, r.root) for r in jaccard_join._components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {(x, root(x)) for x in parent}


@pytest.mark.parametrize("sizes", [(0, 1, 1), (16, 1 << 10, 1 << 20), (16, 1, 1)])
def test_without_ids(spark, monkeypatch, sizes):
    """Exact whether the bit map is full (one word), tells ids apart, or would be too large to be made."""
    from idlecost.llm import common

    for name, size in zip(("MAP_BITS", "LEAST_WORDS", "MOST_WORDS"), sizes, strict=True):
        monkeypatch.setattr(common, name, size)
    rng = random.Random(7)
    rows = [(rng.randrange(4000), f"t{i}") for i in range(3000)] + [(None, "a"), (None, "b")]
    gone = {rng.randrange(4000) for _ in range(900)}
    for extra in ([], [None]):
        ids = spark.createDataFrame([(g,) for g in [*gone, *extra]], "x long")
        got = common.without_ids(docs(spark, rows), "doc_id", ids)
        assert got.columns == docs(spark, rows).columns
        want = sorted((r for r in rows if r[0] not in gone | set(extra)), key=row_key)
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=row_key) == want
        got = common.with_ids(docs(spark, rows), "doc_id", ids)
        want = sorted((r for r in rows if r[0] in gone | set(extra)), key=row_key)
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=row_key) == want


def test_drop_map_follows_the_number_of_ids():
    from idlecost.llm.common import LEAST_WORDS, MOST_WORDS, map_words

    assert map_words(0) == map_words(1) == LEAST_WORDS
    assert [map_words(n) for n in (4097, 100_000, 1_000_000)] == [2048, 1 << 15, 1 << 18]
    assert map_words(4 * MOST_WORDS) == MOST_WORDS and map_words(4 * MOST_WORDS + 1) is None


def test_exact_groups_over_many_partitions_without_broadcasts(spark):
    """One group over all range partitions, joined at their borders by a merge."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    rng = random.Random(12)
    rows = [(i, "a b c" if i % 3 else "ab  c" if i % 2 else sentence(rng, 5)) for i in range(300)] + [(None, "abc")] * 3
    try:
        for k, v in zip(old, ("-1", "23", "false"), strict=True):
            spark.conf.set(k, v)
        table = docs(spark, rows)
        got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.content_groups(table).collect()]
        kept = [(r.doc_id, r.text) for r in exact_dedup.exact_dedup(table).collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    same = [i for i, t in rows if t.replace(" ", "") == "abc"]
    alone = [(i, t) for i, t in rows if t.replace(" ", "") != "abc"]
    best = min(i for i, t in rows if t in ("a b c", "ab  c"))
    assert sorted(got, key=row_key) == sorted([(i, best, len(same), i == best) for i in same] + [(i, i, 1, True) for i, _ in alone], key=row_key)
    assert sorted(kept) == sorted([*alone, (best, dict(rows)[best])])


def test_near_dedup_keeps_one_of_each_group(spark):
    rows = odd_rows()
    kept = [r.doc_id for r in jaccard_join.near_dedup(docs(spark, rows)).collect()]
    want = [c for c in components(rows)]
    assert sorted(x for x in set(kept) if x is not None) == sorted({d for d, _, c in want if d is not None and d == c})
    assert kept.count(32) <= 1


def test_near_dedup_of_repeated_and_null_ids(spark):
    """Rows go by their text as well as by their id: one row of each component stays, all without words do."""
    rng = random.Random(11)
    a, b, c, d, e, f = (sentence(rng, 40, 100_000) for _ in range(6))
    rows = [(1, a), (None, a + " more"), (None, b), (None, c), (None, None), (None, " "),  # (a), (c): unique null-id rows stay
            (5, d), (6, d + " more"), (6, e),  # (b): 6 goes with d and stays with e
            (7, f), (7, f + " more"), (8, f), (7, ""),  # one component, its smallest id repeated
            (9, c + " more"), (10, b), (10, b)]
    got = [(r.doc_id, r.text) for r in jaccard_join.near_dedup(docs(spark, rows)).collect()]
    of = {x: sorted((r for r in got if r[1] and r[1].startswith(x)), key=row_key) for x in (a, b, c, d, e, f)}
    assert of[a] == [(1, a)] and of[b] == [(10, b)] and of[c] == [(9, c + " more")] and of[d] == [(5, d)] and of[e] == [(6, e)]
    assert len(of[f]) == 1 and of[f][0][0] == 7
    assert sorted((r for r in got if not (r[1] or "").strip()), key=row_key) == sorted([(None, None), (None, " "), (7, "")], key=row_key)
    alone = [(None, sentence(rng, 30, 100_000)) for _ in range(20)] + [(3, sentence(rng, 30, 100_000)) for _ in range(5)]
    got = [(r.doc_id, r.text) for r in jaccard_join.near_dedup(docs(spark, alone + [(1, alone[0][1]), (4, alone[20][1])])).collect()]
    assert sorted(got, key=row_key) == sorted(alone[1:] + [(1, alone[0][1])], key=row_key)
