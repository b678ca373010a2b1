"""Language identification by string-kernel classification.

A text is the set of hashed 2- to 4-byte n-grams of its lower-cased letters (all
else is one boundary sign): the blended-spectrum presence kernel counts the n-grams
two texts share, scaled by both sets' sizes.  Landmarks chosen from the learning
rows give the Nystroem map; one-versus-rest kernel ridge regression on it gives a
weight for each landmark and language.  Scoring is a product of batches of presence
vectors with landmarks times weights, which is folded into one matrix beforehand.

Every language of the learning rows is learned.  Rows are bounded: ``PER_LANGUAGE`` of
each language, fewer where there are so many languages that ``SAMPLE`` rows in all would be
passed (one of each at least), those lowest in a hash order of the id.  Only their
presence vectors (2 KB each) reach the driver.

Defined cases: a text that is null or has no letter gets ``und`` with score 0, as do
all texts when there is nothing to learn from; repeated rows get equal results; a
null id counts as empty text in the fold; other columns are ignored by ``languages``
and returned unchanged by ``known_language``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idlecost.llm.common import crc_mod, full_text, lowest_by_hash, table
from idlecost.llm.wordhash import free_memory, slices

BITS = 14
PER_LANGUAGE = 300
SAMPLE = 19_200
LANDMARKS = 400
RIDGE = 1e-2
SHARPNESS = 4.0
UNKNOWN = "und"
#: Documents whose language scores below this are rejected by ``known_language``.
MIN_SCORE = 0.3

_LETTERS = np.full(256, 32, dtype=np.uint32)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # features x languages
    bias: np.ndarray


def presence(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, rows x features of 0 and 1) of consecutive rows."""
    for a, b, data, offset in slices(texts, limit=1 << 20, rows=256):
        x = np.zeros((b - a, 1 << BITS), dtype=np.uint8)
        if len(data):
            c = _LETTERS[data]
            doc = np.repeat(np.arange(b - a, dtype=np.int64) << BITS, np.diff(offset))
            flat, code = x.reshape(-1), c.copy()
            for n in range(2, 5):
                if len(c) < n:
                    break
                code = code[:-1] | (c[n - 1:] << np.uint32(8 * (n - 1)))
                own = doc[:len(code)] == doc[n - 1:]
                bucket = ((code ^ np.uint32(0x1F83D9AB * n & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
                flat[(doc[:len(code)] + bucket)[own]] = 1
        yield a, b, x


def _learning_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, x in presence(batch.column("text")):
            bits = np.packbits(x, axis=1)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").slice(a, b - a), "lang": batch.column("lang").slice(a, b - a),
                "bits": pa.array([r.tobytes() for r in bits], pa.binary())})


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on the bounded sample of the rows of ``docs`` outside the held-out fold."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), full_text(text_col).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & (crc_mod("doc_id", 3) != 1))
    of_each = max(1, min(PER_LANGUAGE, SAMPLE // max(1, rows.select("lang").distinct().count())))
    chosen = lowest_by_hash(rows.select("doc_id", "lang"), "lang", "doc_id", of_each)
    ids = [r[0] for r in chosen.select("doc_id").distinct().collect()]
    id_type = rows.schema["doc_id"].dataType.simpleString()
    bits = (rows.where(F.col("doc_id").isin([i for i in ids if i is not None]) & F.col("text").rlike(r"\p{L}"))
            .mapInArrow(_learning_rows, f"doc_id {id_type}, lang string, bits binary")
            .groupBy("doc_id", "lang").agg(F.min("bits").alias("bits")).orderBy("lang", "doc_id").collect())
    return fit([r["lang"] for r in bits], np.array([np.unpackbits(np.frombuffer(r["bits"], np.uint8)) for r in bits], dtype=np.float32))


def fit(labels: list[str], x: np.ndarray) -> Model:
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), dtype=np.float32), np.zeros(0))
    x = x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    # Landmarks: evenly spaced rows, which come sorted by language.
    at = np.unique(np.linspace(0, len(x) - 1, min(LANDMARKS, len(x))).astype(int))
    marks = x[at]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    phi = (x @ marks.T).astype(np.float64) @ root
    y = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    mean, centre = phi.mean(axis=0), y.mean(axis=0)
    phi = phi - mean
    w = np.linalg.solve(phi.T @ phi + RIDGE * len(x) * np.eye(phi.shape[1]) / phi.shape[1], phi.T @ (y - centre))
    return Model(languages, (marks.T @ (root @ w)).astype(np.float32), centre - mean @ w)


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in batches:
            for a, b, x in presence(batch.column("text")):
                letters = batch.column("letters").slice(a, b - a).to_numpy(zero_copy_only=False).astype(bool)
                best, score = np.full(b - a, len(model.languages)), np.zeros(b - a)
                if len(model.languages):
                    size = np.sqrt(np.maximum(x.sum(axis=1, dtype=np.int64), 1))
                    margin = (x.astype(np.float32) @ model.weights) / size[:, None] + model.bias
                    power = np.exp(SHARPNESS * (margin - margin.max(axis=1, keepdims=True)))
                    best = np.where(letters, margin.argmax(axis=1), best)
                    score = np.where(letters, (power / power.sum(axis=1, keepdims=True)).max(axis=1), 0.0)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(a, b - a), "held_out": batch.column("held_out").slice(a, b - a),
                    "lang_pred": pa.array(names[best], pa.string()), "score": pa.array(score)})
    return run


def languages(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``."""
    model = model or learn(docs, id_col, text_col, lang_col)
    texts = docs.select(F.col(id_col).alias("doc_id"), (crc_mod(id_col, 3) == 1).alias("held_out"),
                        full_text(text_col).alias("text"), full_text(text_col).rlike(r"\p{L}").alias("letters"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(_scorer(model), f"doc_id {id_type}, held_out boolean, lang_pred string, score double")


def known_language(docs: DataFrame, min_score: float = MIN_SCORE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is known with ``min_score`` at least, all columns unchanged."""
    model = learn(docs, id_col, text_col, lang_col)
    keep_types = docs.schema
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not model.languages:
                continue
            letters = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            score = np.zeros(batch.num_rows)
            column = batch.column(text_at)
            for a, b, x in presence(column.fill_null("")):
                size = np.sqrt(np.maximum(x.sum(axis=1, dtype=np.int64), 1))
                margin = (x.astype(np.float32) @ model.weights) / size[:, None] + model.bias
                power = np.exp(SHARPNESS * (margin - margin.max(axis=1, keepdims=True)))
                score[a:b] = (power / power.sum(axis=1, keepdims=True)).max(axis=1)
            keep = pa.array(letters & (score >= min_score))
            yield batch.select(range(batch.num_columns - 1)).filter(keep)
        free_memory()

    letters = "letters"
    while letters in map(str.lower, docs.columns):
        letters += "_"
    return docs.withColumn(letters, full_text(text_col).rlike(r"\p{L}")).mapInArrow(run, keep_types)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))
