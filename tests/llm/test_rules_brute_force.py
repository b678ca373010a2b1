"""Templates, verdicts and context scores against plain versions of their methods."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from idlecost.llm import line_templates, pii, quality_rules
from llm_cases import docs, odd_rows, sentence


# --- line templates -----------------------------------------------------------

def parsed(line):
    """(leaf, weak, masked tokens) of a line, None without a token."""
    tokens = line.split()
    if not tokens:
        return None
    masked = ["<*>" if re.search("[0-9]", t) else t for t in tokens]
    weak = len(tokens) < line_templates.SHORT
    if 2 * masked.count("<*>") > len(tokens):
        weak, masked = True, [re.sub("[0-9]+", "<*>", t) for t in tokens]
    return (len(tokens), *masked[:line_templates.DEPTH]), weak, tuple(masked)


def gathered(lines):
    """The template of each of a list of token tuples, joined one by one to the template most like it."""
    made, to = [], []
    for line in lines:
        agree = [sum(a == b for a, b in zip(t, line, strict=True)) for t in made]
        best = max(range(len(made)), key=lambda k: (agree[k], -k), default=None)
        if best is not None and agree[best] >= line_templates.SIMILARITY * len(line):
            made[best] = tuple(a if a == b else "<*>" for a, b in zip(made[best], line, strict=True))
        else:
            best = len(made)
            made.append(line)
        to.append(best)
    return [made[k] for k in to]


def dropped_lines(rows, keys, min_docs):
    """key -> numbers of the dropped lines; ``keys`` are the documents' keys in the order of ``rows``."""
    seen, at, said = collections.Counter(), collections.defaultdict(list), collections.defaultdict(list)
    for (_, text), key in set(zip(rows, keys, strict=True)):
        for n, line in enumerate((text or "").split("\n")):
            p = parsed(line)
            if p:
                at[p[0], p[2]].append((key, n, p[1]))
            if len(line.split()) >= line_templates.LONG:
                said[tuple(line.split())].append((key, n))
    repeats = collections.Counter(zip(rows, keys, strict=True))
    for (_, text), key in repeats:
        for line in (text or "").split("\n"):
            p = parsed(line)
            if p:
                seen[p[0], p[2]] += repeats[(_, text), key]
    leaves = collections.defaultdict(list)
    for leaf, masked in at:
        leaves[leaf].append(masked)
    of = collections.defaultdict(set)  # template -> lines
    for leaf, lines in leaves.items():
        lines.sort(key=lambda m: (-seen[leaf, m], " ".join(m)))
        n = leaf[0] - math.ceil(line_templates.SIMILARITY * leaf[0]) + 1
        for m in lines:
            of[leaf, m].add(m)
        for b in range(n):
            groups = collections.defaultdict(list)
            for m in lines:
                groups[m[line_templates.DEPTH + b::n]].append(m)
            for g in groups.values():
                for m, t in zip(g, gathered(g), strict=True):
                    of[leaf, t].add(m)
    gone = collections.defaultdict(set)
    for (leaf, _), lines in of.items():
        places = [p for m in lines for p in at[leaf, m]]
        need = min_docs * (line_templates.MORE if any(w for *_, w in places) else 1)
        if len({key for key, *_ in places}) >= need:
            for key, n, _ in places:
                gone[key].add(n)
    for places in said.values():
        for key, n in places:
            if key != min(k for k, _ in places):
                gone[key].add(n)
    return gone


def log_rows(seed):
    rng = random.Random(seed)
    names, places = ["ann", "bob", "cid", "dan", "eve"], ["office", "depot", "yard"]
    passage = sentence(rng, 30, 1000)

    def line():
        kind = rng.randrange(9)
        if kind == 0:
            return f"user {rng.choice(names)} logged in from the {rng.choice(places)} at {rng.randrange(99)}"
        if kind == 1:
            return f"user {rng.choice(names)} logged off from the {rng.choice(places)} late on {rng.choice(names)} duty {sentence(rng, 1, 30)}"
        if kind == 2:
            return f"2024-01-{rng.randrange(10, 31)} {rng.randrange(24)}:{rng.randrange(60)} 10.0.0.{rng.randrange(9)} ok"
        if kind == 3:
            return rng.choice(["all rights", "menu", "", " ", "home page"])
        if kind == 4:
            return passage
        if kind == 5:
            return " ".join(["the", "same", "start"] + [rng.choice("abcd") for _ in range(7)])
        return sentence(rng, rng.randrange(1, 26), 100_000)

    rows = [(i, "\n".join(line() for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    return rows + rows[:2] + [(700, None), (701, ""), (702, "\n\n"), (3, "another text of the same id"), (None, passage)]


@pytest.mark.parametrize(("seed", "group"), [(1, 4096), (2, 4096), (1, 2), (3, 2)])
def test_line_report_against_a_plain_tree(spark, monkeypatch, seed, group):
    monkeypatch.setattr(line_templates, "GROUP", group)
    rows = log_rows(seed)
    df = docs(spark, rows)
    keyed = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), line_templates._row_key("doc_id", "text").alias("key")).collect()
    key_of = {(r.doc_id, r.text): r.key for r in keyed}
    keys = [key_of[i, t or ""] for i, t in rows]
    gone = dropped_lines(rows, keys, line_templates.MIN_DOCS)
    want = []
    for (i, text), key in zip(rows, keys, strict=True):
        lines = (text or "").split("\n")
        clean = "\n".join(x for n, x in enumerate(lines) if n not in gone[key])
        want.append((str(i), len(lines) if text else 0, len(gone[key]), len(clean), hashlib.sha256(clean.encode()).hexdigest()))
    got = [(str(r.doc_id), r.n_lines, r.n_dropped_lines, r.kept_chars, r.clean_sha256) for r in line_templates.line_report(df).collect()]
    assert sorted(got) == sorted(want)
    assert sum(w[2] for w in want) > 50 and any(w[2] == 0 and w[1] for w in want)


# --- quality rules ------------------------------------------------------------

def verdict(text):
    """(covered words, longest repeat of MIN_REPEAT words or more, verdict on repeats) by comparing all pairs of places."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    best = [0] * (n + 1)
    after = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        row = [0] * (n + 1)
        for j in range(n - 1, -1, -1):
            if i != j and words[i] == words[j]:
                row[j] = 1 + after[j + 1]
        best[i], after = max(row), row
    covered = {k for i in range(n) if best[i] >= quality_rules.MIN_REPEAT for k in range(i, i + best[i])}
    longest = max((b for b in best if b >= quality_rules.MIN_REPEAT), default=0)
    bad = longest > quality_rules.MAX_REPEAT or (
        len(covered) > quality_rules.MAX_COVERED and 100 * len(covered) > quality_rules.MAX_COVERED_PERCENT * n)
    return len(covered), longest, bad


def test_verdict_against_all_pairs_of_places(spark):
    rng = random.Random(12)
    rows = odd_rows()
    for k in range(50):
        parts = [sentence(rng, rng.randrange(4, 60), 10_000_000) for _ in range(rng.randrange(1, 5))]
        own = [sentence(rng, rng.randrange(20, 120), 10_000_000) for _ in range(rng.randrange(1, 7))]
        pieces = own + [rng.choice(parts) for _ in range(rng.randrange(1, 6))]
        rng.shuffle(pieces)
        rows.append((1000 + k, " ".join(pieces)))
    rows += [(2000, "la " * 30 + sentence(rng, 300, 10_000_000)), (2001, sentence(rng, 300, 10_000_000) + " a b" * 30)]
    rows = [r for r in rows if len((r[1] or "").split()) < 1000]
    got = quality_rules.quality(docs(spark, rows)).collect()
    want = collections.Counter((str(i), *verdict(t)) for i, t in (r[:2] for r in rows))
    base_failed = collections.Counter(str(r.doc_id) for r in got if r.base_failed)
    found = collections.Counter((str(r.doc_id), r.covered_words, r.longest_repeat if r.longest_repeat >= quality_rules.MIN_REPEAT else 0,
                                 not r.kept) for r in got if not r.base_failed)
    # What the base fails already has no verdict of the method.
    assert not found - want and sum(found.values()) + sum(base_failed.values()) == len(rows)
    method = [r for r in got if not r.base_failed]
    assert {r.kept for r in method} == {True, False}


# --- personal data ------------------------------------------------------------

#: Valid and invalid strings of each kind.
PLANTED = {
    "email": (["a.b@c-d.example.org", "x_1%+-@y.z"], ["a@b", "@b.co"]),
    "ip": (["10.0.0.255", "0.0.0.0"], ["10.0.0.256", "1.2.3"]),
    "card": (["4111 1111 1111 1111", "5500-0000-0000-0004", "378282246310005"], ["4111 1111 1111 1112", "1234"]),
    "phone": (["+49 (30) 901820-11", "+1.202.555.0143"], ["+12 34", "+1234567890123456"]),
    "iban": (["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"], ["DE89370400440532013001", "de89370400440532013000"]),
    "ssn": (["123-45-6789", "899-01-0001"], ["000-12-3456", "123-00-6789", "123-45-0000", "900-12-3456"]),
}
CONTEXT = {"iban": "konto", "ssn": "SSN"}


@pytest.mark.parametrize("kind", list(PLANTED))
def test_every_kind_is_found_and_checked(spark, kind):
    rng = random.Random(3)
    good, bad = PLANTED[kind]
    rows, want = [], {}
    for k in range(60):
        value = rng.choice(good if k % 3 else bad)
        lead = sentence(rng, rng.randrange(0, 40), 300)
        lead = re.sub("[0-9]", "q", lead) + f" {CONTEXT.get(kind, 'see')} "
        rows.append((k, f"{lead}{value} then " + re.sub("[0-9]", "q", sentence(rng, 5, 300))))
        want[k] = [f"{kind}:{len(lead)}:{len(lead) + len(value)}"] if k % 3 else []
    got = {r.doc_id: [s for s in r.spans.split(",") if s.startswith(kind + ":")] for r in pii.pii_spans(docs(spark, rows)).collect()}
    assert got == want


def test_context_words_are_whole_words_within_reach(spark):
    gap = lambda n: " " + "." * (n - 2) + " "
    rows = [("classname 123-45-6789", 0), ("lossness 123-45-6789", 0), ("ssn 123-45-6789", 1), ("SSNs: 123-45-6789", 1), ("123-45-6789 (tax id)", 1),
            (f"x ssn{gap(pii.NEAR - 3)}123-45-6789", 1), (f"x ssn{gap(pii.NEAR - 2)}123-45-6789", 0),
            (f"xssn{gap(pii.NEAR - 3)}123-45-6789", 0), (f"ssn{gap(pii.NEAR - 3)}123-45-6789", 1),
            (f"123-45-6789{gap(pii.NEAR - 3)}ssn x", 1), (f"123-45-6789{gap(pii.NEAR - 3)}ssn", 1), (f"123-45-6789{gap(pii.NEAR - 3)}ssnx", 0),
            (f"123-45-6789{gap(pii.NEAR - 2)}ssn", 0), ("ssn of a test 123-45-6789", 0), ("latest ssn 123-45-6789", 1),
            ("caliban DE89370400440532013000", 1), ("version DE89370400440532013000", 0), ("bank version DE89370400440532013000", 1)]
    got = {r.doc_id: bool(r.spans) for r in pii.pii_spans(docs(spark, [(i, t) for i, (t, _) in enumerate(rows)])).collect()}
    assert got == {i: bool(n) for i, (_, n) in enumerate(rows)}
