"""Toxicity and language identification: held-out accuracy and odd cases."""

import random

import numpy as np

from idlecost.llm import language_id, toxicity
from idlecost.llm.common import table
from llm_cases import docs, odd_rows

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    d = table(spark, SF, "documents")
    got = language_id.languages(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred <> 'und'").collect()
    assert len(got) > 200 and np.mean([r.lang == r.lang_pred for r in got]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_language_keeps_clean_documents(spark):
    d = table(spark, SF, "documents")
    kept = language_id.known_language(d)
    assert kept.columns == d.columns
    assert kept.count() >= 0.99 * d.where("text rlike '[a-z]'").count()


def test_every_language_is_learned(spark):
    """Seventy languages, more than the sample has rows for at the usual number each."""
    rng = random.Random(70)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(70):
        syllables = ["".join(rng.choices(letters, k=3)) for _ in range(12)]
        rows += [(100 * k + i, " ".join(rng.choice(syllables) + rng.choice(syllables) for _ in range(40)), f"l{k:02}") for i in range(24)]
    df = docs(spark, rows)
    got = [r for r in language_id.languages(df).join(df.select("doc_id", "lang"), "doc_id").collect() if r.held_out]
    assert {r.lang_pred for r in got} == {f"l{k:02}" for k in range(70)} and np.mean([r.lang == r.lang_pred for r in got]) > 0.98


def test_known_language_with_clashing_names(spark):
    df = docs(spark, odd_rows()).withColumnsRenamed({"keep_id": "letters", "part": "_llm_letters"})
    got = language_id.known_language(df)
    assert got.columns == df.columns and got.count() > 0


def test_language_odd_cases(spark):
    rows = odd_rows() + [(60, "123 456 !!"), (61, "日本")]
    got = {r.doc_id: r for r in language_id.languages(docs(spark, rows)).collect()}
    assert len(language_id.languages(docs(spark, rows)).collect()) == len(rows)
    for i in (20, 21, 22, 60):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[61].lang_pred in ("en", "de", "fr")
    unlabelled = docs(spark, [(1, "some words", None), (2, None, None)])
    assert {r.lang_pred for r in language_id.languages(unlabelled).collect()} == {"und"}
    assert language_id.languages(docs(spark, [])).collect() == [] and language_id.known_language(docs(spark, [])).collect() == []


def test_toxicity_held_out_accuracy(spark):
    larger = "/root/testdata/sf0.1"
    d, labels = table(spark, larger, "documents"), table(spark, larger, "labels")
    got = toxicity.toxicity(d, toxicity.learn(d, labels)).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50 and np.mean([r.predicted == r.toxic for r in got]) > 0.95


def toxic_corpus(rng, n=160):
    words = [f"{a}{b}{c}" for a in ("ba", "lo", "mi", "ter") for b in ("na", "ri", "so") for c in ("n", "st", "la")]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.choice([6, 60, 400]))]
        if i % 2:
            for _ in range(1 + len(text) // 60):
                text[rng.randrange(len(text))] = rng.choice(["zargoth", "zargothly", "vexplume"])
        rows.append((i, " ".join(text)))
        labels.append((i, i % 2))
    return rows, labels, words


def test_toxicity_finds_misspellings_and_long_texts(spark):
    rng = random.Random(9)
    rows, labels, words = toxic_corpus(rng)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs(spark, rows), known)
    long_clean = [rng.choice(words) for _ in range(20_000)]
    long_toxic = list(long_clean)
    long_toxic[9000], long_toxic[9003] = "zargoth", "vexplume"
    new = [(900, " ".join(long_clean)), (901, " ".join(long_toxic)), (902, "banan zargothz lorin"), (903, "banan lorin misost"), (904, ""), (905, None)]
    got = {r.doc_id: r for r in toxicity.toxicity(docs(spark, new), model).collect()}
    assert [got[i].predicted for i in (900, 901, 902, 903)] == [0, 1, 1, 0]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[904].score == got[905].score


def test_toxicity_odd_cases(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = odd_rows()
    got = toxicity.toxicity(docs(spark, odd), toxicity.learn(docs(spark, odd), none)).collect()
    assert len(got) == len(odd) and {r.score for r in got} == {0.0}
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0), (3, 1), (3, 1), (777, 1)], "doc_id long, toxic int")
    assert len(toxicity.toxicity(docs(spark, odd), toxicity.learn(docs(spark, odd), labels)).collect()) == len(odd)
    assert toxicity.toxicity(docs(spark, []), toxicity.learn(docs(spark, []), none)).collect() == []


def test_learning_windows_reach_the_last_word():
    for n in range(200):
        starts = toxicity._window_starts(n)
        assert len(starts) == len(set(starts)) and (not starts) == (n == 0)
        assert {i for a in starts for i in range(a, min(a + toxicity.WINDOW, n))} == set(range(n))
        assert all(a + toxicity.WINDOW <= n for a in starts) or n < toxicity.WINDOW


def test_toxic_last_words_of_short_and_very_long_texts_are_learned(spark):
    """The only toxic words are the last new ones, behind up to 60,000 code points of others."""
    rng = random.Random(4)
    plain = ["".join(rng.choices("abcdefghijklm", k=6)) for _ in range(6000)]
    bad = ["zorvux", "quuxyz", "wyzzor", "xuvrop"]
    rows, labels = [], []
    for i in range(240):
        toxic = i % 2
        words = rng.sample(plain, rng.choice([17, 19, 22, 60])) if i % 8 else [rng.choice(plain) for _ in range(9000)]
        rows.append((i, " ".join(words + (rng.sample(bad, 3) if toxic else []))))
        labels.append((i, 1, toxic))
    df, known = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(df, toxicity.learn(df, known)).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 240 and len(held) > 30 and np.mean([r.predicted == r.doc_id % 2 for r in held]) > 0.95


def test_toxicity_learns_from_texts_without_words(spark):
    df = docs(spark, [(i, None if i % 2 else " ") for i in range(20)])
    known = spark.createDataFrame([(i, 1, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.toxicity(df, toxicity.learn(df, known)).collect()} <= {0, 1}
