"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its 3- to 5-byte n-grams with boundary signs (lower-cased
ASCII, words are runs of letters, digits and non-ASCII bytes), each a row of a hashed
embedding table; a window of ``WINDOW`` words is the mean of its words' mean
embeddings, and a linear softmax scores it.  Table and softmax are trained jointly in
numpy, so unseen misspellings share the n-gram vectors of known words.  Windows run
over the first occurrences of a text's words, so that a word repeated many times does
not weigh more.  A document's score is that of its highest window, over all windows of
the whole text: a few toxic words count the same in a short and in a very long text.

Learning: at first every window carries its document's label, then each document is
represented by its highest windows.  The learning rows are a bounded sample: of the
labelled rows outside the held-out fold the ``PER_CLASS`` of each label lowest in a
hash order of the id.  Of these the whole texts are learned: tasks find each one's
words in order of their first occurrence, which is all that windows need, and the
driver gets these.  Learning windows step by half a window, and one ends at the last
word.  The threshold is set on the windows that scoring uses.  For scoring the softmax
is folded into the table, one number an n-gram bucket, which is all that goes to the
executors (512 KB).

Defined cases: null counts as empty; a text without words has the score of a mean of
zero; without labels of both kinds to learn from every score is 0; documents without a
label, or with several, are scored like any other; repeated rows get equal scores; a
null id counts as empty text in the fold; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idlecost.llm.common import crc_mod, full_text, lowest_by_hash, table
from idlecost.llm.wordhash import Words, mix, slices, word_hashes

BITS = 17
DIM = 8
WINDOW = 16
PER_CLASS = 1200
SEED = 7

_SIGN = np.full(256, 32, dtype=np.uint32)
for _a, _b, _to in ((48, 58, 48), (97, 123, 97), (65, 91, 97), (128, 256, 128)):
    _SIGN[_a:_b] = np.arange(_to, _to + _b - _a)


class Model(NamedTuple):
    weight: np.ndarray  # one number a bucket: embedding times the difference of the two softmax rows
    bias: float


def _signs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded signs, and the words' first and last positions in them."""
    c = np.concatenate([np.array([32], np.uint32), _SIGN[data], np.full(6, 32, np.uint32)])
    inside = c != 32
    start = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    end = np.flatnonzero(inside[:-1] & ~inside[1:])
    return c, start, end


def _buckets(c: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For n of 3, 4, 5 the bucket of the n-gram at each position."""
    code = c[:-2] | (c[1:-1] << np.uint32(8)) | (c[2:] << np.uint32(16))
    yield 3, (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    code = code[:-1] | (c[3:] << np.uint32(24))
    yield 4, ((code ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
    code = (code[:-1] * np.uint32(0xC2B2AE35)) ^ (c[4:] * np.uint32(0x27D4EB2F))
    yield 5, (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def _word_values(data: np.ndarray, offset: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean weight of the n-grams of each word that is new in its text, and the texts' bounds among these words."""
    c, start, end = _signs(data)
    h = word_hashes(Words(c.astype(np.uint8), offset, start, end - start + 1, offset))
    doc = np.searchsorted(offset, start - 1, side="right") - 1
    new = np.sort(np.unique(mix(h ^ mix(doc.astype(np.uint64) + np.uint64(1))), return_index=True)[1])
    start, end = start[new], end[new]
    total, count = np.zeros(len(start)), np.zeros(len(start))
    for n, bucket in _buckets(c):
        run = np.concatenate([[0.0], np.cumsum(weight[bucket], dtype=np.float64)])
        have = np.maximum(end - start + 4 - n, 0)  # n-grams inside the word and its two boundary signs
        total += run[start - 1 + have] - run[start - 1]
        count += have
    return total / np.maximum(count, 1), np.searchsorted(start - 1, offset)


def _window_means(values: np.ndarray, bounds: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Each text's highest mean over ``width`` consecutive words (over all, if it has fewer)."""
    run = np.concatenate([[0.0], np.cumsum(values)])
    n = np.diff(bounds)
    out = np.where(n > 0, (run[bounds[1:]] - run[bounds[:-1]]) / np.maximum(n, 1), 0.0)
    long = np.flatnonzero(n >= width)
    if len(long):
        means = (run[width:] - run[:-width]) / width
        edges = np.stack([bounds[long], bounds[long] + n[long] - width + 1], axis=1).reshape(-1)
        means = np.append(means, -np.inf)
        out[long] = np.maximum.reduceat(means, np.minimum(edges, len(means) - 1))[::2]
    return out


# --- learning -----------------------------------------------------------------

class _Bags(NamedTuple):
    """Windows of the learning texts, and their buckets: word u has bag[bag_start[u]:bag_start[u + 1]]."""

    bag: np.ndarray  # bucket of each (word, n-gram), words one after the other
    bag_start: np.ndarray
    windows: np.ndarray  # windows x WINDOW, -1 beyond a short text
    text_of: np.ndarray
    words: np.ndarray  # the texts' words, text t having words[bounds[t]:bounds[t + 1]]
    bounds: np.ndarray


def _first_words(text: bytes) -> list[bytes]:
    """The words of a text, each with its boundary signs, in order of their first occurrence."""
    c, start, end = _signs(np.frombuffer(text, np.uint8))
    low = c.astype(np.uint8).tobytes()
    return list(dict.fromkeys(low[a - 1:b + 2] for a, b in zip(start.tolist(), end.tolist(), strict=True)))


def _condensed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts cut down to the first occurrences of their words."""
    for batch in batches:
        words = [b" ".join(w[1:-1] for w in _first_words(t.encode())) for t in batch.column("_text").to_pylist()]
        yield pa.RecordBatch.from_pydict({"_id": batch.column("_id"), "_words": pa.array(words, pa.binary())})


def _window_starts(n: int) -> list[int]:
    """Where the learning windows of ``n`` words begin; the last one ends at the last word."""
    starts = list(range(0, max(n - WINDOW, 0) + 1, WINDOW // 2)) if n else []
    return starts + [n - WINDOW] if n > WINDOW and starts[-1] < n - WINDOW else starts


def _bags(texts: list[bytes]) -> _Bags:
    seen: dict[bytes, int] = {}
    windows, text_of, words, bounds = [], [], [], [0]
    for t, text in enumerate(texts):
        ids = [seen.setdefault(w, len(seen)) for w in _first_words(text)]
        for at in _window_starts(len(ids)):
            part = ids[at:at + WINDOW]
            windows.append(part + [-1] * (WINDOW - len(part)))
            text_of.append(t)
        words += ids
        bounds.append(len(words))
    bags = []
    for word in seen:
        c = np.frombuffer(word, np.uint8).astype(np.uint32)
        padded = np.concatenate([c, np.full(5, 32, np.uint32)])
        bags.append(np.concatenate([b[:max(len(c) - n + 1, 0)] for n, b in _buckets(padded)]))
    starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64)
    return _Bags(np.concatenate(bags).astype(np.int64) if bags else np.zeros(0, np.int64), starts,
                 np.array(windows, dtype=np.int64).reshape(-1, WINDOW), np.array(text_of, dtype=np.int64),
                 np.array(words, dtype=np.int64), np.array(bounds, dtype=np.int64))


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 4, rounds: int = 4, batch: int = 256, rate: float = 0.3) -> Model:
    """Embeddings and softmax by Adagrad over windows of the texts."""
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(1 << BITS, dtype=np.float32), -np.inf)
    bags = _bags(texts)
    random = np.random.default_rng(SEED)
    table_ = (random.random((1 << BITS, DIM), dtype=np.float32) - 0.5) / DIM
    soft, bias = np.zeros((2, DIM), dtype=np.float32), np.zeros(2, dtype=np.float32)
    squares, soft_squares, bias_squares = np.full(1 << BITS, 1e-6, np.float32), np.full((2, DIM), 1e-6, np.float32), np.full(2, 1e-6, np.float32)

    def train(chosen: np.ndarray) -> None:
        nonlocal soft, bias
        for at in range(0, len(chosen), batch):
            rows = chosen[at:at + batch]
            words = bags.windows[rows]
            there = words >= 0
            use, back = np.unique(words[there], return_inverse=True)
            sizes = bags.bag_start[use + 1] - bags.bag_start[use]
            first = np.concatenate([[0], np.cumsum(sizes)])
            grams = bags.bag[np.arange(first[-1]) + np.repeat(bags.bag_start[use] - first[:-1], sizes)]
            vectors = np.add.reduceat(table_[grams], first[:-1], axis=0) / sizes[:, None].astype(np.float32)
            window = np.repeat(np.arange(len(rows)), there.sum(axis=1))
            n = np.maximum(there.sum(axis=1), 1).astype(np.float32)
            edges = np.searchsorted(window, np.arange(len(rows)))
            mean = np.add.reduceat(vectors[back], edges, axis=0) / n[:, None]
            logits = mean @ soft.T + bias
            power = np.exp(logits - logits.max(axis=1, keepdims=True))
            slope = power / power.sum(axis=1, keepdims=True)
            slope[np.arange(len(rows)), labels[bags.text_of[rows]]] -= 1
            slope /= len(rows)
            to_soft, to_mean = slope.T @ mean, slope @ soft
            share = (to_mean / n[:, None])[window]
            to_word = np.stack([np.bincount(back, share[:, d], minlength=len(use)) for d in range(DIM)], axis=1) / sizes[:, None]
            gram, place = np.unique(grams, return_inverse=True)
            spread = np.repeat(to_word, sizes, axis=0)
            to_gram = np.stack([np.bincount(place, spread[:, d], minlength=len(gram)) for d in range(DIM)], axis=1).astype(np.float32)
            squares[gram] += (to_gram ** 2).mean(axis=1)
            table_[gram] -= rate * to_gram / np.sqrt(squares[gram])[:, None]
            soft_squares[...] += to_soft ** 2
            bias_squares[...] += slope.sum(axis=0) ** 2
            soft = soft - rate * 0.3 * to_soft / np.sqrt(soft_squares)
            bias = bias - rate * 0.3 * slope.sum(axis=0) / np.sqrt(bias_squares)

    # Joint training needs a direction to start from: opposite random rows.
    soft[1] = random.standard_normal(DIM).astype(np.float32)
    soft[0] = -soft[1]
    for _ in range(epochs):
        train(random.permutation(len(bags.windows)))

    def word_values() -> np.ndarray:
        weight = table_ @ (soft[1] - soft[0])
        return np.add.reduceat(weight[bags.bag], bags.bag_start[:-1]) / np.diff(bags.bag_start)

    def window_scores() -> np.ndarray:
        values, there = word_values(), bags.windows >= 0
        return np.where(there, values[bags.windows], 0).sum(axis=1) / np.maximum(there.sum(axis=1), 1) + bias[1] - bias[0]

    for _ in range(rounds):  # then each text by its highest windows
        order = np.lexsort((-window_scores(), bags.text_of))
        text = bags.text_of[order]
        place = np.arange(len(order)) - np.searchsorted(text, text)
        chosen = order[place < np.where(labels[text] == 1, 1, 3)]
        for _ in range(epochs):
            train(random.permutation(chosen))
    # The threshold stands midway between the learning texts of both labels, and not below the
    # score of unknown words, so that these alone don't make a text toxic.
    top = _window_means(word_values()[bags.words], bags.bounds) + bias[1] - bias[0]
    middle = (np.percentile(top[labels == 0], 99) + np.percentile(top[labels == 1], 1)) / 2
    threshold = max(float(middle), float(bias[1] - bias[0]) + 0.25)
    return Model((table_ @ (soft[1] - soft[0])).astype(np.float32), float(bias[1] - bias[0]) - threshold)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on the bounded sample of labelled rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
    known = known.where(F.col("_toxic").isin(0, 1) & F.col("_id").isNotNull() & (crc_mod("_id", 5) != 0))
    known = known.groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    sample = {r["_id"]: r["_toxic"] for r in lowest_by_hash(known, "_toxic", "_id", PER_CLASS).collect()}
    if not sample:
        return Model(np.zeros(1 << BITS, dtype=np.float32), -np.inf)
    texts = docs.where(F.col(id_col).isin(list(sample))).select(F.col(id_col).alias("_id"), full_text(text_col).alias("_text"))
    id_type = texts.schema["_id"].dataType.simpleString()
    words = texts.mapInArrow(_condensed, f"_id {id_type}, _words binary")
    rows = words.groupBy("_id").agg(F.min("_words").alias("_words")).orderBy("_id").collect()
    return fit([bytes(r["_words"]) for r in rows], np.array([sample[r["_id"]] for r in rows], dtype=np.int64))


# --- scoring ------------------------------------------------------------------

def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offset in slices(batch.column("text"), limit=4 << 20):
                logit = _window_means(*_word_values(data, offset, model.weight)) + model.bias
                score = 1 / (1 + np.exp(-np.clip(logit, -700, 700)))
                score = np.where(np.isneginf(logit), 0.0, score)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(a, b - a), "held_out": batch.column("held_out").slice(a, b - a),
                    "score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32))})
    return run


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    # The space at the end keeps the n-grams of neighbouring texts apart.
    texts = docs.select(F.col(id_col).alias("doc_id"), (crc_mod(id_col, 5) == 0).alias("held_out"),
                        F.concat(full_text(text_col), F.lit(" ")).alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(_scorer(model), f"doc_id {id_type}, held_out boolean, score double, predicted int")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))
