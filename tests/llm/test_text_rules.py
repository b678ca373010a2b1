"""Quality rules, personal data, line templates against brute force and planted cases."""

import random

import numpy as np
import pytest

from idlecost.llm import line_templates, pii, quality_rules
from llm_cases import docs, odd_rows, personal, quality, sentence


def test_quality_counts_odd_cases(spark):
    rng = random.Random(2)
    loop = " ".join(["la la land"] * 40)
    rows = odd_rows() + [(50, loop), (51, sentence(rng, 60) + "\n" + loop), (52, "a b c d e f g h i j\n\n \na b c d e f g h i j\nx"), (53, "\n"), (54, "#*$ %&|<> ü　ß")]
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
           for r in quality_rules.quality(docs(spark, rows)).collect()}
    assert got == {(r[0], *quality(r[1])) for r in rows}


def test_quality_verdict(spark):
    rng = random.Random(4)
    clean, passage = sentence(rng, 800, 50_000), sentence(rng, 60, 50_000)
    rows = [(1, clean), (2, passage + " " + clean[:1500] + " " + passage), (3, clean + " " + passage), (4, "word " * 500)]
    got = {r.doc_id: (r.base_failed, r.kept, r.longest_repeat) for r in quality_rules.quality(docs(spark, rows)).collect()}
    assert got[1] == (False, True, 0) and got[3][1] and got[2][:2] == (True, False) or got[2][2] == 60
    assert got[2][2] == 60 and not got[2][1] and not got[4][1]


def test_quality_method_fails_texts_that_the_base_passes(spark):
    rng = random.Random(9)
    own = lambda n: sentence(rng, n, 10_000_000)
    twice = lambda passage, n: f"{own(n // 2)} {passage} {own(n - n // 2)} {passage} {own(5)}"
    several = [own(15) for _ in range(4)]
    rows = [(1, twice(own(95), 805)), (2, twice(own(1900), 16_195)), (3, twice(own(60), 19_875)),
            (4, " ".join(f"{p} {own(110)}" for p in several + several)), (5, twice(own(9), 79)), (6, twice(own(45), 1000)), (7, own(2000))]
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.quality(docs(spark, rows)).collect()}
    assert got == {i: (False, i >= 5) for i in range(1, 8)}


@pytest.mark.parametrize("seed", range(6))
def test_repeated_substrings(seed):
    rng = np.random.default_rng(seed)
    letters = rng.integers(0, 3, 70).astype(np.uint64)
    suffixes, longest = quality_rules.repeated_substrings(letters)
    s = letters.tolist()

    def common(i, j):
        k = 0
        while max(i, j) + k < len(s) and s[i + k] == s[j + k]:
            k += 1
        return k

    want = {i: max(common(i, j) for j in range(len(s)) if j != i) for i in range(len(s))}
    assert dict(zip(suffixes.tolist(), longest.tolist(), strict=True)) == want


PERSONAL = [
    "mail a.b+c@ex-ample.co.uk, x@y and a@b.c_d@e.f; a@b..c q@@r.s .@.- é@b.c",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.02.3.255 1..2.3.4.5 99999999999999999999.1.1.1 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 4990108715159781 12 345 - 7 0000000000000000 4111  1111",
    "+1 (988) 555-2485 call +49.30.1234567, +1 +12 ++44 20 7946 0958 +1((((9 +123456789012345678",
    "日本 é 4111111111111111 x@ü.de 10.0.0.1",
    "+4111111111111111 5.5.5.5@mail.de",
    "",
]


def test_personal_base_spans(spark):
    rows = [(i, t) for i, t in enumerate(PERSONAL)] + [(90, None), (91, "a" * 50_000), (92, "1" * 50_000), (93, "a." * 20_000 + "@"), (94, "a@" + "b." * 20_000)]
    got = {r.doc_id: ((r.n_email, r.n_ip, r.n_card, r.n_phone), r.base_sha256) for r in pii.pii_spans(docs(spark, rows)).collect()}
    assert got == {i: personal(t) for i, t in rows}


def test_personal_added_kinds(spark):
    rows = [(1, "pay to iban DE89370400440532013000 now"), (2, "pay to iban DE89370400440532013001 now"), (3, "my ssn is 123-45-6789."),
            (4, "part 123-45-6789 of the set"), (5, "konto GB82 WEST 1234 5698 7654 32 ok"), (6, "clean words only")]
    got = {r.doc_id: r.spans for r in pii.pii_spans(docs(spark, rows)).collect()}
    assert got == {1: "iban:12:34", 2: "", 3: "ssn:10:21", 4: "", 5: "iban:6:33", 6: ""}


def test_redact(spark):
    rows = [(1, "write to a@b.co or 10.0.0.1!"), (2, None), (3, "nothing")]
    df = pii.redact(docs(spark, rows))
    assert df.columns == docs(spark, rows).columns
    assert {r.doc_id: r.text for r in df.collect()} == {1: "write to [email] or [ip]!", 2: None, 3: "nothing"}


def test_redact_and_drop_lines_with_clashing_names(spark):
    rows = [(1, "write to a@b.co"), (2, None), (3, "nothing")] + [(10 + i, f"own line {i} of its own text\nreport number {i} was sent on time") for i in range(6)]
    names = {"keep_id": "_pii", "score": "_masked", "part": "_text", "set_key": "_lines", "n": "_row"}
    df = docs(spark, rows).withColumnsRenamed(names).withColumnsRenamed({"sequence_id": "_clean"})
    for got in (pii.redact(df), line_templates.drop_template_lines(df)):
        assert got.columns == df.columns
        keep = [c for c in df.columns if c != "text"]
        assert sorted(map(str, got.select(*keep).collect())) == sorted(map(str, df.select(*keep).collect()))
    assert pii.redact(df).where("doc_id = 1").first().text == "write to [email]"


def test_templates_generalise_fields():
    lines = ["user ann logged in from the office", "user bob logged in from the office", "disk full on the main storage node"]
    assert line_templates.templates([x.split(" ") for x in lines]) == [
        "user <*> logged in from the office", "user <*> logged in from the office", "disk full on the main storage node"]


def test_recurring_lines_go_and_clean_ones_stay(spark):
    rng = random.Random(6)
    names = ["ann", "bob", "cid", "dan", "eve", "fay"]
    rows = []
    for i, name in enumerate(names):
        own = sentence(rng, 12, 100_000)
        rows.append((i, f"{own}\nreport number {i * 17} was sent by {name} on time\nok then\n{own} more"))
    rows += [(10, None), (11, ""), (12, "\n\n"), (13, sentence(rng, 9))]
    rows += [(20, "this line stands here alone twice"), (20, "this line stands here alone twice")]
    got = {r.doc_id: r.text for r in line_templates.drop_template_lines(docs(spark, rows)).collect()}
    for i in range(6):
        a, _, c, d = rows[i][1].split("\n")
        assert got[i] == "\n".join([a, c, d])
    assert {i: got[i] for i in (10, 11, 12, 13, 20)} == {r[0]: r[1] for r in rows[6:]}
    report = {r.doc_id: (r.n_lines, r.n_dropped_lines, r.clean_sha256) for r in line_templates.line_report(docs(spark, rows)).collect()}
    assert report[0] == (4, 1, line_templates.sha256_without(rows[0][1], [1])) and report[10][:2] == (0, 0) and report[12][:2] == (3, 0)


def test_long_short_and_numeric_lines(spark):
    """Long lines stay in one of their few documents; short and numeric lines go from 20 documents on."""
    rng = random.Random(12)
    passage, sure = sentence(rng, 60, 100_000), lambda: " ".join("".join(rng.choices("klmnopqrst", k=6)) for _ in range(8))
    own = {i: sure() for i in range(40)}
    number = lambda: f"2024-0{rng.randrange(1, 9)}-1{rng.randrange(9)} 1{rng.randrange(9)}:{rng.randrange(10, 60)} 10.0.{rng.randrange(9)}.1 {rng.choice([200, 404])} {rng.randrange(9999)}"
    rows = []
    for i in range(40):
        lines = [own[i]] + ["All rights reserved"] * (i < 20) + ["See page 7"] * (i >= 25) + [number()] * (i < 20) + [f"{i + 10} 2.{i} 3 {i}"] * (i >= 25) + [passage] * (i in (3, 33))
        rows.append((i, "\n".join(lines)))
    got = {r.doc_id: r.text.split("\n") for r in line_templates.drop_template_lines(docs(spark, rows)).collect()}
    assert sorted(passage in got[i] for i in (3, 33)) == [False, True]
    for i, text in rows:
        assert [x for x in got[i] if x != passage] == ([own[i]] if i < 20 else [x for x in text.split("\n") if x != passage])


@pytest.mark.parametrize("group", [4096, 50])
def test_templates_of_a_large_leaf_are_whole(spark, monkeypatch, group):
    """Few variants of a template among many other lines of their leaf: none stays at any leaf size."""
    monkeypatch.setattr(line_templates, "GROUP", group)
    rng = random.Random(8)
    rows = [(i, "the new day " + " ".join("".join(rng.choices("klmnopqrst", k=6)) for _ in range(6))) for i in range(600)]
    rows += [(1000 + 10 * k + i, f"the new day {own} v{'abcdef'[i]} and then v{'fedcba'[i]} came") for k, own in enumerate(["began", "ended"]) for i in range(6)]
    got = {r.doc_id: r.text for r in line_templates.drop_template_lines(docs(spark, rows)).collect()}
    assert got == {i: t if i < 1000 else "" for i, t in rows}


def test_empty_tables(spark):
    none = docs(spark, [])
    assert quality_rules.quality(none).collect() == [] and pii.pii_spans(none).collect() == []
    assert line_templates.line_report(none).collect() == [] and pii.redact(none).collect() == []
