"""Periodic runs of words: a suffix automaton whose link tree is accessed like a link-cut tree.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical) that no neighbouring word extends; those of ``MIN_EXPONENT`` periods and
``MIN_LENGTH`` words or more are found, all of them and exactly.

1. Stretches.  Each five words of such a run recur within q words, q being at most a
   quarter of the run.  So runs lie in the stretches of words under five-word windows
   that recur within a quarter of their stretch; windows that don't are put out, round by
   round.  Nothing else of a text can hold a run, and most texts have no stretch.
2. Suffix automaton of a stretch.  Its states are classes of substrings with the same
   ends; the suffix links form a tree, and the path from the root to the state of a
   prefix holds all suffixes of that prefix, shorter ones first.
3. Access.  A link-cut tree over the links (splay trees of preferred paths) keeps for each
   preferred path the last end at which its substrings occurred.  Appending the word at place i
   accesses the prefix's state: the path from the root becomes one preferred path with the
   end i.  Each segment of an earlier path that goes over to it tells: the longest
   substring on it has L words, ends at i and ended last at e.
4. Squares and runs.  If d = i - e <= L both occurrences make a square of period d, and
   with all L words the stretch i - L - d + 1 .. i has it.  No longer suffix ended at e, so
   the stretch can't go further to the left; no later end exists, so d is its smallest
   period.  The same begin and period come again with each further word of the run: the
   last one ends it.

Words are compared by 64-bit hashes.  A stretch is worked on in one task with about half
a kilobyte a word; appending costs amortised O(log) a word.

Defined cases: null counts as empty; without words there is no run and the collapsed
text is empty; a text of any length is worked on as a whole; repeated rows get equal
results; other columns are ignored by ``find_runs`` and returned unchanged by
``collapse_runs``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idlecost.llm.common import SPACE_CLASS, full_text, table
from idlecost.llm.wordhash import Words, mix, slices, window_hashes, word_hashes, words

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Words of a window: 2 q + WINDOW - 1 <= max(MIN_LENGTH, MIN_EXPONENT q) for every period q.
WINDOW = 5
#: Rounds of putting windows out; with fewer, stretches are longer and the runs the same.
ROUNDS = 16


# --- 1. stretches ---------------------------------------------------------------

def stretches(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the words that runs can lie in; text d has the words first[d]:first[d + 1]."""
    none = np.zeros(0, dtype=np.int64)
    grams = window_hashes(h, WINDOW)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(doc[:len(grams)] == doc[WINDOW - 1:]) if len(grams) else none
    if not len(at):
        return none, none
    key = mix(grams[at] ^ mix(doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    gap = np.where(same, at[order][1:] - at[order][:-1], np.iinfo(np.int64).max // 8)
    near = np.full(len(at), np.iinfo(np.int64).max // 8)
    near[order[1:]] = gap
    near[order[:-1]] = np.minimum(near[order[:-1]], gap)
    at, near = at[near < len(h)], near[near < len(h)]
    start = end = none
    for _ in range(ROUNDS):
        if not len(at):
            return none, none
        # All windows inside a run are left, so a stretch is one of consecutive windows.
        new = np.append(True, (at[1:] > at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]]))
        start = at[new]
        end = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)] + WINDOW
        length = (end - start)[np.cumsum(new) - 1]
        able = (length >= MIN_LENGTH) & (MIN_EXPONENT * near <= length)
        if able.all():
            break
        at, near = at[able], near[able]
    return start, end


# --- 2. suffix automaton --------------------------------------------------------

def suffix_automaton(letters: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(link, length of the longest substring) of each state, and the states of the prefixes.

    State 1 is the root; 0 stands for none.
    """
    link, size, step = [0, 0], [0, 0], [{}, {}]
    prefixes = []
    last = 1
    for letter in letters:
        new = len(link)
        link.append(1)
        size.append(size[last] + 1)
        step.append({})
        prefixes.append(new)
        p = last
        while p and letter not in step[p]:
            step[p][letter] = new
            p = link[p]
        if p:
            q = step[p][letter]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                clone = len(link)
                link.append(link[q])
                size.append(size[p] + 1)
                step.append(step[q].copy())
                while p and step[p].get(letter) == q:
                    step[p][letter] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return link, size, prefixes


# --- 3. access ------------------------------------------------------------------

class LastEnds:
    """The link tree as preferred paths, each a splay tree whose root knows the path's last end.

    In a splay tree nodes are ordered by depth; ``up`` of its root is the parent of the
    path's top.  A path that loses its lower part leaves its last end to both parts.
    """

    def __init__(self, link: list[int]):
        self.up = list(link)
        self.left = [0] * len(link)
        self.right = [0] * len(link)
        self.end = [-1] * len(link)

    def _splay(self, v: int) -> None:
        up, left, right, end = self.up, self.left, self.right, self.end
        while True:
            p = up[v]
            if not p:
                return
            if left[p] == v:
                side = True
            elif right[p] == v:
                side = False
            else:
                return
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                if (left[g] == p) == side:
                    self._rotate(p, g, side)
                    self._rotate(v, p, side)
                else:
                    self._rotate(v, p, side)
                    self._rotate(v, g, not side)
            else:
                self._rotate(v, p, side)

    def _rotate(self, v: int, p: int, is_left: bool) -> None:
        """Put ``v`` above its parent ``p``."""
        up, left, right = self.up, self.left, self.right
        g = up[p]
        if is_left:
            b = right[v]
            left[p] = b
            right[v] = p
        else:
            b = left[v]
            right[p] = b
            left[v] = p
        if b:
            up[b] = p
        up[p] = v
        up[v] = g
        if g and left[g] == p:
            left[g] = v
        elif g and right[g] == p:
            right[g] = v
        else:  # p was the root
            self.end[v] = self.end[p]

    def access(self, v: int, i: int) -> list[tuple[int, int]]:
        """Make the path from the root to ``v`` one path with the last end ``i``; (lowest state,
        last end) of each segment of earlier paths on it, from below."""
        up, right, end = self.up, self.right, self.end
        met = []
        x, below = v, 0
        while x:
            self._splay(x)
            if end[x] >= 0:
                met.append((x, end[x]))
            lower = right[x]
            if lower:
                end[lower] = end[x]
            right[x] = below
            below, x = x, up[x]
        self._splay(v)
        end[v] = i
        return met


# --- 4. squares and runs --------------------------------------------------------

def runs_of(letters: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence, by start and period."""
    link, size, prefixes = suffix_automaton(letters)
    tree = LastEnds(link)
    last: dict[tuple[int, int], int] = {}
    for i, state in enumerate(prefixes):
        for x, e in tree.access(state, i):
            d, common = i - e, size[x]
            if common >= d and common + d >= MIN_LENGTH and common + d >= MIN_EXPONENT * d:
                last[i - common - d + 1, d] = i
    return sorted((a, i - a + 1, d) for (a, d), i in last.items())


def _text_runs(w: Words) -> dict[int, list[tuple[int, int, int]]]:
    """The runs of each text that has any, in word numbers of the text."""
    h = word_hashes(w)
    out: dict[int, list[tuple[int, int, int]]] = {}
    for a, b in zip(*(x.tolist() for x in stretches(h, w.first)), strict=True):
        found = runs_of(np.unique(h[a:b], return_inverse=True)[1].tolist())
        if found:
            row = int(np.searchsorted(w.first, a, side="right")) - 1
            shift = a - int(w.first[row])
            out.setdefault(row, []).extend((s + shift, n, q) for s, n, q in found)
    return out


def _collapsed(w: Words, whole: bytes, row: int, runs: list[tuple[int, int, int]]) -> bytes:
    """The text's words but those that a run holds after its first period, joined by spaces."""
    a, b = int(w.first[row]), int(w.first[row + 1])
    change = np.zeros(b - a + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    stay = np.flatnonzero(np.cumsum(change[:-1]) == 0) + a
    return b" ".join(whole[s:s + n] for s, n in zip(w.start[stay].tolist(), w.length[stay].tolist(), strict=True))


def text_runs(texts: pa.Array) -> Iterator[tuple[int, int, list[int], dict[int, list[tuple[int, int, int]]], list[bytes]]]:
    """By slice: (from, to, words of each text, runs of the texts that have any, collapsed texts)."""
    for at, to, data, offset in slices(texts, limit=4 << 20):
        w = words(data, offset)
        runs = _text_runs(w)
        whole = data.tobytes()
        said = [_collapsed(w, whole, r, runs[r]) if r in runs else b" ".join(whole[offset[r]:offset[r + 1]].split()) for r in range(to - at)]
        yield at, to, np.diff(w.first).tolist(), runs, said


_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to, n_words, runs, said in text_runs(batch.column("text")):
            sizes = np.zeros(to - at + 1, dtype=np.int32)
            flat = []
            for r in sorted(runs):
                sizes[r + 1] = len(runs[r])
                flat += runs[r]
            values = np.array(flat, dtype=np.int64).reshape(-1, 3)
            found = pa.StructArray.from_arrays([pa.array(values[:, k]) for k in range(3)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(at, to - at), pa.array(n_words, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), found),
                 pa.array(said, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start, then period), collapsed text of every row of ``docs``."""
    texts = docs.select(F.col(id_col).alias("doc_id"), full_text(text_col).alias("text"))
    return texts.mapInArrow(_run_rows, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, n_words long, runs {_RUNS}, collapsed string")


def collapse_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the texts that hold a run collapsed: each run keeps its first period; other rows unchanged."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text_col)
            texts = batch.column(place)
            changed = {}
            for at, _, _, runs, said in text_runs(pc.fill_null(texts, "")):
                changed |= {at + r: said[r].decode() for r in runs}
            if changed:
                new = pa.array([changed.get(i, t) for i, t in enumerate(texts.to_pylist())], texts.type)
                batch = pa.RecordBatch.from_arrays([new if i == place else c for i, c in enumerate(batch.columns)], schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, docs.schema)


def planted_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text: the contract's texts; of every tenth document (by checksum) the words from
    word a on repeat with a period p.  A null id changes nothing."""
    text = full_text("text")
    rows = docs.select("doc_id", text.alias("text"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    own = F.array_remove(F.split("text", f"[{SPACE_CLASS}]+"), "")
    rows = rows.withColumns({"g": F.call_function("div", F.col("h"), F.lit(10)), "words": F.when(F.col("h") % 10 == 0, own)})
    rows = rows.withColumn("n", F.size("words").cast("long"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.call_function("div", F.col("n") - F.col("a"), 3 + F.col("g") % 8))

    def word(i: Column) -> Column:
        return F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))

    repeated = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), word), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def op13_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(planted_texts(table(spark, sf_dir, "documents")))
    runs = F.col("runs")
    # Greater exact length / period by cross products; the runs' order settles ties.
    best = F.reduce(runs, F.get(runs, F.lit(0)), lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]), F.lit("\n")))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), *[F.col(f"best.{k}").alias(k) for k in ("start", "length", "period")],
        F.call_function("div", F.col("best.length") * 1000, F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
