"""Secret scans: window entropy per character class over candidate strings, with an allow-list.

Base kinds are patterns: an assignment to a secret's name, an access key's prefix, a long
lower-case hexadecimal string.  The method adds strings that look random: a candidate is
a run of ``WINDOW`` characters or more of one class; a window of ``WINDOW`` characters
slides over it, and the Shannon entropy of its characters follows from counts that change
by one character leaving and one entering.  With g(c) = c log2 c the window's entropy is
log2 WINDOW - S / WINDOW, S the sum of g over its counts, so a step changes S by
g(c + 1) - g(c) for the entering character and g(c - 1) - g(c) for the leaving one.
Sorted places give these counts for all steps of all candidates of a batch at once, and g is kept in
whole units of 2^-32, so S is exact.  Windows above a class's entropy that hold
enough characters of each of its kinds are joined to spans.

Classes are tried from the narrowest on; a span inside a base span, or inside one of a
narrower class, adds nothing.  A span is suppressed when the allow-list matches it or its
surroundings, ``NEAR`` code points of the same white-space-free token on either side:
addresses, checksums, placeholders and the like.  Base spans stay whatever it says.

Defined cases: null counts as empty; without a match counts are 0 and both span strings
empty; base matches that fail their check are dropped without another try; a text or a
candidate of any length is scanned whole (long candidates in overlapping blocks); repeated
rows get equal results; other columns are ignored by ``secret_spans`` and returned
unchanged by ``mask_secrets``, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idlecost.llm.common import full_text, table
from idlecost.llm.wordhash import IS_SPACE, slices

# The base kinds of the contract, in its order.
BASE = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_CUE = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
MIN_ASSIGNED = 8
ACCESS = re.compile("AKIA[A-Z0-9]+")
MIN_ACCESS = 16
MIN_HEX = 32

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


class CharClass(NamedTuple):
    """A class of characters, the entropy (bits) a window needs, and how many it needs of which characters."""

    name: str
    chars: str
    bits: float
    needs: tuple[tuple[str, int], ...]


WINDOW = 20
#: Narrowest first.  A random window has about 3.2, 3.75 and 4.0 bits; prose, names and numbers miss a need.
CLASSES = (
    CharClass("entropy_hex", DIGITS + "abcdefABCDEF", 2.8, ((DIGITS, 2), ("abcdefABCDEF", 2))),
    CharClass("entropy_base32", UPPER + "234567", 3.3, ((UPPER, 2), ("234567", 2))),
    CharClass("entropy_base64", LOWER + UPPER + DIGITS + "+/_-", 3.8, ((LOWER, 2), (UPPER, 2), (DIGITS, 2))),
)
KINDS = (*BASE, *(c.name for c in CLASSES))
#: What may look random and is no secret.
ALLOW = (
    r"(?i)\bhttps?://|\bwww\.", r"(?i)\b(?:sha-?(?:1|224|256|384|512)|md5|crc32|etag|integrity)[:=-]", r"(?i)data:[a-z]+/",
    r"(?i)example|sample|dummy|placeholder|changeme|redacted", r"(?i)abcdefgh|01234567|12345678",
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", r"(.)\1{7}",
)
NEAR = 40

_UNIT = 1 << 32
#: g(c) = c log2 c in whole units, for every count in a window.
GAIN = np.array([0] + [round(c * math.log2(c) * _UNIT) for c in range(1, WINDOW + 2)], dtype=np.int64)
#: Characters of candidates that are worked on at once.
BLOCK = 1 << 20


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars.encode())] = True
    return out


_ANY = np.logical_or.reduce([_flags(c.chars) for c in CLASSES])
_LOWER_HEX = _flags(DIGITS + "abcdef")


def runs_of(inside: np.ndarray, borders: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the maximal runs of True of ``least`` or more; no run crosses a border."""
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    inner = borders[(borders > 0) & (borders < len(inside))]
    begin[inner] = inside[inner]
    end[inner - 1] = inside[inner - 1]
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    long = stop - start >= least
    return start[long], stop[long]


def window_gains(chars: np.ndarray, run: np.ndarray) -> np.ndarray:
    """S of the window that ends at each place of ``chars`` (fewer characters at a run's begin).

    ``run`` numbers the runs in order.  For each step the count of the entering
    character among the window's others, and that of the leaving one, are differences
    of ranks among the places of that character in the run.
    """
    n = len(chars)
    place = np.arange(n)
    key = (run.astype(np.int64) * 256 + chars) * n
    order = np.argsort(key, kind="stable")
    ranked = (key + place)[order]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = place
    entering = rank - np.searchsorted(ranked, key + np.maximum(place - WINDOW + 1, 0))
    step = GAIN[entering + 1] - GAIN[entering]
    old = place - WINDOW
    leaves = (old >= 0) & (run[np.maximum(old, 0)] == run)
    now, old = place[leaves], old[leaves]
    leaving = np.searchsorted(ranked, key[old] + now) - rank[old]
    step[now] -= GAIN[leaving] - GAIN[leaving - 1]
    total = np.cumsum(step)
    first = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if n else place
    before = (total - step)[first]
    return total - before[np.cumsum(np.bincount(first, minlength=n)) - 1] if n else total


def _random_windows(chars: np.ndarray, run: np.ndarray, of: CharClass) -> np.ndarray:
    """Whether the window that ends at each place lies in one run and looks random."""
    n = len(chars)
    if n < WINDOW:
        return np.zeros(n, dtype=bool)
    hit = window_gains(chars, run) <= round((math.log2(WINDOW) - of.bits) * WINDOW * _UNIT)
    hit[:WINDOW - 1] = False
    hit[WINDOW - 1:] &= run[WINDOW - 1:] == run[:n - WINDOW + 1]
    for some, least in of.needs:
        have = np.concatenate([[0], np.cumsum(_flags(some)[chars])])
        hit[WINDOW - 1:] &= have[WINDOW:] - have[:n - WINDOW + 1] >= least
    return hit


def _blocks(start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The runs cut into pieces of ``BLOCK`` at most that share ``WINDOW - 1`` characters, some pieces at once."""
    piece = BLOCK - WINDOW + 1
    many = np.maximum(-(-(end - start - WINDOW + 1) // piece), 1)
    a = np.repeat(start, many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * piece
    b = np.minimum(a + BLOCK, np.repeat(end, many))
    group = np.cumsum(b - a) // BLOCK
    for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(group)) + 1):
        yield a[part], b[part]


def random_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, of: CharClass) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the random-looking spans in the candidates data[start[i]:end[i]], in order."""
    member = _flags(of.chars)
    firsts, lasts = [], []
    for a, b in _blocks(start, end):
        size = b - a
        place = np.arange(size.sum()) + np.repeat(a - (np.cumsum(size) - size), size)
        chars = data[place]
        run = np.repeat(np.arange(len(a)), size)
        # A run of the class ends where a character outside it stands; its number tells it apart.
        inside = member[chars]
        run = np.cumsum(np.append(False, (run[1:] != run[:-1]) | (inside[1:] != inside[:-1]))) if len(run) else run
        run, chars, place = run[inside], chars[inside], place[inside]
        hit = _random_windows(chars, run, of)
        lasts.append(place[hit] + 1)
        firsts.append(place[hit] + 1 - WINDOW)
    if not firsts or not sum(map(len, firsts)):
        none = np.zeros(0, dtype=np.int64)
        return none, none
    first, last = np.unique(np.concatenate(firsts)), np.unique(np.concatenate(lasts))
    candidate = np.searchsorted(start, first, side="right")
    new = np.append(True, (first[1:] > last[:-1]) | (candidate[1:] != candidate[:-1]))
    return first[new], last[np.append(np.flatnonzero(new)[1:] - 1, len(last) - 1)]


class Span(NamedTuple):
    start: int
    order: int
    end: int


def _allowed(text: bytes, start: int, end: int, allow: list[re.Pattern]) -> bool:
    lo, hi = start, end
    while lo > 0 and start - lo < 4 * NEAR and not IS_SPACE[text[lo - 1]]:
        lo -= 1
    while hi < len(text) and hi - end < 4 * NEAR and not IS_SPACE[text[hi]]:
        hi += 1
    before = text[lo:start].decode(errors="ignore")[-NEAR:]
    after = text[end:hi].decode(errors="ignore")[:NEAR]
    said = before + text[start:end].decode(errors="ignore") + after
    return any(p.search(said) for p in allow)


def _add(out: dict[int, list[Span]], row: int, span: Span) -> None:
    out.setdefault(row, []).append(span)


def find_secrets(texts: pa.Array, allow: list[re.Pattern]) -> dict[int, list[Span]]:
    """The spans of each row that has any, in code points, by start and kind."""
    out: dict[int, list[Span]] = {}
    for at, _, data, offset in slices(texts, limit=4 << 20):
        start, end = runs_of(_ANY[data], offset, WINDOW)
        if not len(start):
            continue
        # Code points begin at bytes that continue none; a place is its count of them since the text's begin.
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])

        def add(a: int, b: int, order: int, lo: int, row: int) -> None:
            _add(out, at + row, Span(int(points[a] - points[lo]), order, int(points[b] - points[lo])))

        if int((end - start).max()) >= MIN_HEX:
            for a, b in zip(*(x.tolist() for x in runs_of(_LOWER_HEX[data], offset, MIN_HEX)), strict=True):
                row = int(np.searchsorted(offset, a, side="right")) - 1
                add(a, b, BASE.index("hex"), int(offset[row]), row)
        for i, of in enumerate(CLASSES):
            for a, b in zip(*(x.tolist() for x in random_spans(data, start, end, of)), strict=True):
                row = int(np.searchsorted(offset, a, side="right")) - 1
                lo, hi = int(offset[row]), int(offset[row + 1])
                near = 4 * NEAR + 4
                cut = max(lo, a - near)
                if not _allowed(data[cut:min(hi, b + near)].tobytes(), a - cut, b - cut, allow):
                    add(a, b, len(BASE) + i, lo, row)
    cue = pc.match_substring_regex(texts, ASSIGN_CUE).to_numpy(zero_copy_only=False)
    for r in np.flatnonzero(cue).tolist():
        for m in ASSIGN.finditer(texts[r].as_py()):
            if len(m.group(2)) >= MIN_ASSIGNED:
                _add(out, r, Span(m.start(), BASE.index("assign"), m.end()))
    cue = pc.match_substring(texts, "AKIA").to_numpy(zero_copy_only=False)
    for r in np.flatnonzero(cue).tolist():
        for m in ACCESS.finditer(texts[r].as_py()):
            if m.end() - m.start() >= MIN_ACCESS:
                _add(out, r, Span(m.start(), BASE.index("access"), m.end()))
    return {r: _without_inner(spans) for r, spans in out.items()}


def _without_inner(spans: list[Span]) -> list[Span]:
    """All base spans, and the added ones that lie in no other span of a lower order; sorted."""
    spans = sorted(spans, key=lambda s: (s.start, -s.end, s.order))
    kept: list[Span] = []
    reach = [-1] * len(KINDS)  # by order, the furthest end of the spans so far
    for s in spans:
        if s.order < len(BASE) or all(reach[k] < s.end for k in range(s.order)):
            kept.append(s)
        reach[s.order] = max(reach[s.order], s.end)
    return sorted(kept)


_FOUND = "array<struct<start:bigint,order:int,end:bigint,kind:string>>"


def _span_rows(allow: tuple[str, ...]):
    patterns = [re.compile(p) for p in allow]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find_secrets(batch.column("text"), patterns)
            sizes = np.zeros(batch.num_rows + 1, dtype=np.int32)
            flat = []
            for r in sorted(found):
                sizes[r + 1] = len(found[r])
                flat += found[r]
            values = pa.StructArray.from_arrays(
                [pa.array([s.start for s in flat], pa.int64()), pa.array([s.order for s in flat], pa.int32()),
                 pa.array([s.end for s in flat], pa.int64()), pa.array([KINDS[s.order] for s in flat], pa.string())],
                ["start", "order", "end", "kind"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), values)], ["doc_id", "found"])
    return run


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """doc_id, found: the spans (start, order, end, kind) of every row of ``docs``, in code points, by start and kind."""
    texts = docs.select(F.col(id_col).alias("doc_id"), full_text(text_col).alias("text"))
    return texts.mapInArrow(_span_rows(allow), f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, found {_FOUND}")


def mask_secrets(docs: DataFrame, text_col: str = "text", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """``docs`` with each span in ``text_col`` replaced by its kind in brackets; of overlapping spans the first."""
    patterns = [re.compile(p) for p in allow]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at)
            found = find_secrets(pc.fill_null(texts, ""), patterns)
            if found:
                said = texts.to_pylist()
                for r, spans in found.items():
                    said[r] = _masked(said[r], spans)
                batch = pa.RecordBatch.from_arrays([pa.array(said, texts.type) if i == at else c for i, c in enumerate(batch.columns)],
                                                   schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, docs.schema)


def _masked(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at:s.start], f"[{KINDS[s.order]}]"]
            at = s.end
    return "".join(out) + text[at:]


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    spans = F.col("found")

    def joined(a: Column) -> Column:
        return F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(order: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["order"] == order)).cast("long")

    return found.select("doc_id", *[number(i).alias(f"n_{kind}") for i, kind in enumerate(BASE)],
                        F.sha2(joined(F.filter(spans, lambda s: s["order"] < len(BASE))), 256).alias("base_sha256"),
                        joined(spans).alias("spans"))
