"""Small tables with the odd cases, and brute-force versions of the contracts."""

from __future__ import annotations

import collections
import hashlib
import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]")

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use for their own results
    T.StructField("keep_id", T.StringType()), T.StructField("score", T.StringType()), T.StructField("n", T.IntegerType()),
    T.StructField("part", T.StringType()), T.StructField("set_key", T.StringType()), T.StructField("sequence_id", T.StringType()),
])


def docs(spark, rows):
    """rows: (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src1", None, "k", None, 1, "p", None, "s") for r in rows]
    return spark.createDataFrame(full, DOCS)


def sentence(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def odd_rows(seed: int = 1):
    """Nulls, empty and blank texts, ties, repeated rows, copies but for white space, one very long text."""
    rng = random.Random(seed)
    base = [sentence(rng, 40) for _ in range(12)]
    rows = [(i, t, rng.choice(["en", "de", "fr"]), rng.choice(["src1", "src8", "src15"])) for i, t in enumerate(base)]
    rows += [(20, None, None, None), (21, "", "en", "src1"), (22, " \t\n", "en", None), (23, "one two", "en", "src1"), (24, "one  two", "de", "src8")]
    rows += [(30, base[0], "en", "src1"), (31, base[0].replace(" ", "\n "), "en", "src1"), (32, base[1] + " ", "en", "src1"), (32, base[1] + " ", "en", "src1")]
    rows += [(None, base[2], "en", "src1"), (None, None, None, None), (33, "né 日本 " + base[3], "fr", "src8"), (34, "né 日本 " + base[3], "fr", "src8")]
    rows += [(40, sentence(rng, 30_000, 5000), "en", "src15"), (41, "x" * 60_000, "en", "src15")]
    return rows


def row_key(r):
    return tuple((x is None, x) for x in r)


def exact(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        t = r[1] or ""
        groups[SPACE.sub("", t)].append((-len(t), r[0] is None, r[0] or 0, r[0]))
    out = []
    for norm, members in groups.items():
        members.sort(key=lambda m: m[:3])
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(m[3], members[0][3], len(members), i == 0, sha) for i, m in enumerate(members)]
    return sorted(out, key=row_key)


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def components(rows):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), least.get(root(i)) if sets[i] else r[0]) for i, r in enumerate(rows)), key=row_key)


def quality(text):
    w = WORD.findall(text or "")
    n = len(w)
    grams = [tuple(w[i:i + 5]) for i in range(n - 4)]
    seen = collections.Counter(grams)
    covered = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (n, sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
            n < 10 or 100 * len(covered) > 20 * n)


def personal(text):
    """(counts, digest of the base spans) by the standard library's engine."""
    text = text or ""

    def luhn(d):
        total = 0
        for i, c in enumerate(reversed(d)):
            v = int(c) * (1 + i % 2)
            total += v - 9 if v > 9 else v
        return total % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    spans = [(m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m.group())]
    said = ",".join(f"{name}:{a}:{b}" for a, _, name, b in sorted(spans))
    return tuple(sum(s[1] == k for s in spans) for k in range(4)), hashlib.sha256(said.encode()).hexdigest()
