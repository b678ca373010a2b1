"""Quality rules with suffix-array repetition.

Base rules count words, symbols, repeated lines and words in repeated five-word
windows.  The method then sorts the word suffixes of each text that has such a
window (prefix doubling over word ranks), takes the longest common prefixes of
neighbouring suffixes, and from their intervals the maximal repeated substrings of
``MIN_REPEAT`` words or more: a text fails when these cover more than
``MAX_COVERED`` words and ``MAX_COVERED_PERCENT`` of the text, or when the longest has
more than ``MAX_REPEAT`` words, whatever the text's length.  Both limits lie below what
the base rules take: a short sentence said twice stays, a passage said twice goes.

Defined cases: null counts as empty; without words all counts are 0 and the base
rules fail; a text of any length is worked on as a whole; repeated rows get equal
results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idlecost.llm.common import full_text, table
from idlecost.llm.wordhash import Words, mix, slices, window_hashes, word_hashes, words

WINDOW = 5
MIN_WORDS = 10
BASE_REPEAT_PERCENT = 20
MIN_REPEAT = 8
MAX_COVERED = 40
MAX_COVERED_PERCENT = 10
MAX_REPEAT = 50

_SYMBOL = np.zeros(256, dtype=np.uint8)
_SYMBOL[list(b"#*$%&|<>")] = 1
_POINT = np.ones(256, dtype=np.uint8)  # bytes that begin a code point outside white space
_POINT[0x80:0xC0] = 0
_POINT[list(b" \t\n\x0b\x0c\r")] = 0


def _per_text(flag: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _covered(at: np.ndarray, lengths, first: np.ndarray, n: int) -> np.ndarray:
    """Words of each text under the union of the spans at[i]:at[i] + lengths[i]."""
    step = np.bincount(at, minlength=n + 1) - np.bincount(at + lengths, minlength=n + 1)
    return _per_text(np.cumsum(step[:n]) > 0, first)


def duplicate_lines(w: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    nl = np.flatnonzero(w.data == 10)
    start = np.unique(np.concatenate([w.offset[:-1], nl + 1]))
    start = start[start < len(w.data)]
    doc = np.searchsorted(w.offset, start, side="right") - 1
    end = np.minimum(np.append(nl, len(w.data))[np.searchsorted(nl, start)], w.offset[doc + 1])
    wordy = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, doc = start[wordy], end[wordy], doc[wordy]
    h = word_hashes(Words(w.data, w.offset, start, end - start, w.first))
    order = np.lexsort((h, doc))
    again = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.bincount(doc[order][1:][again], minlength=len(w.offset) - 1)


def repeated_substrings(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position of ``letters`` the longest substring from it that occurs again.

    Suffixes are ranked by prefixes of doubling length, only tied ones anew each
    round; two neighbours' common prefix then comes from the ranks of all rounds.
    Returns (position in suffix order, longest common prefix with a neighbour).
    """
    n = len(letters)
    order = np.argsort(letters, kind="stable")
    new = np.concatenate([[True], letters[order][1:] != letters[order][:-1]])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1] + 1
    levels, width = [], 1
    while True:
        levels.append(np.concatenate([rank, np.zeros(1, dtype=np.int64)]).astype(np.int32))
        tied = np.flatnonzero(np.bincount(rank, minlength=n + 2)[rank] > 1)
        if not len(tied):
            break
        follow = np.where(tied + width < n, rank[np.minimum(tied + width, n - 1)], 0)
        key = (rank[tied] << 32) | follow
        o = np.argsort(key)
        tied, key = tied[o], key[o]
        old = rank[tied]
        at = np.arange(len(tied))
        first = np.concatenate([[True], old[1:] != old[:-1]])
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank = rank.copy()
        rank[tied] = old + np.maximum.accumulate(np.where(fresh, at, 0)) - np.maximum.accumulate(np.where(first, at, 0))
        width *= 2
    suffixes = np.empty(n, dtype=np.int64)
    suffixes[rank - 1] = np.arange(n)
    a, b = suffixes[:-1].copy(), suffixes[1:].copy()
    common = np.zeros(max(n - 1, 0), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        same = (level[np.minimum(a, n)] == level[np.minimum(b, n)]) & (a < n) & (b < n)
        step = same.astype(np.int64) << k
        common += step
        a += step
        b += step
    longest = np.zeros(n, dtype=np.int64)
    longest[:-1] = common
    longest[1:] = np.maximum(longest[1:], common)
    return suffixes, longest


def measures(data: np.ndarray, offset: np.ndarray) -> dict[str, np.ndarray]:
    """All counts of a slice of texts."""
    w = words(data, offset)
    n_words = np.diff(w.first)
    h = word_hashes(w)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    out = {"n_words": n_words, "word_chars": _per_text(_POINT[data], offset), "n_symbols": _per_text(_SYMBOL[data], offset),
           "n_dup_lines": duplicate_lines(w)}
    grams = window_hashes(h, WINDOW)
    at = np.flatnonzero(doc[:len(grams)] == doc[WINDOW - 1:]) if len(grams) else np.zeros(0, dtype=np.int64)
    key = mix(grams[at] ^ mix(doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = at[order][twice]
    out["n_repeat_words"] = _covered(at, WINDOW, w.first, len(h))
    # Only texts with a repeated window can hold a repeated substring of MIN_REPEAT words.
    some = out["n_repeat_words"] >= MIN_REPEAT
    covered, longest = np.zeros(len(n_words), dtype=np.int64), np.zeros(len(n_words), dtype=np.int64)
    place = np.flatnonzero(some[doc])
    if len(place):
        own = doc[place]
        suffixes, common = repeated_substrings(mix(h[place] ^ mix(own.astype(np.uint64) + np.uint64(7))))
        np.maximum.at(longest, own[suffixes], common)
        spans = common >= MIN_REPEAT
        bounds = np.searchsorted(own, np.arange(len(n_words) + 1))
        covered = _covered(suffixes[spans], common[spans], bounds, len(place))
    return out | {"covered_words": covered, "longest_repeat": longest}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offset in slices(batch.column("text"), limit=4 << 20):
            m = measures(data, offset)
            n = m["n_words"]
            failed = (n < MIN_WORDS) | (100 * m["n_repeat_words"] > BASE_REPEAT_PERCENT * n)
            repeats = (m["longest_repeat"] > MAX_REPEAT) | (
                (m["covered_words"] > MAX_COVERED) & (100 * m["covered_words"] > MAX_COVERED_PERCENT * n))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id").slice(a, b - a)} | {k: pa.array(v.astype(np.int64)) for k, v in m.items()}
                | {"base_failed": pa.array(failed), "kept": pa.array(~failed & ~repeats)})


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts and verdicts for every row of ``docs``."""
    texts = docs.select(F.col(id_col).alias("doc_id"), full_text(text_col).alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(_rows, f"doc_id {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                   "n_repeat_words long, covered_words long, longest_repeat long, base_failed boolean, kept boolean")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
