"""Line dedup by a log-template tree.

Lines are parsed at a fixed depth: the first layer of the tree is the number of
tokens, the next ``DEPTH`` layers are the leading tokens, a token with a digit
counting as a variable field ``<*>``.  In a line where most tokens have a digit only the
runs of digits are fields, so that its signs (``<*>-<*>-<*> <*>:<*>``) remain.  In a
leaf, lines gather in templates: a line joins the template that agrees with it on most
positions, if on ``SIMILARITY`` of them at least, and positions that differ become
variable fields.  A template that occurs in ``MIN_DOCS`` documents recurs, and its
lines are dropped; lines of fewer than ``SHORT`` tokens and lines mostly of digits say
less and need ``MORE`` times as many.  A line of ``LONG`` tokens or more that recurs word
for word in fewer documents stays in one of them, as it may be all that its copies hold.

Leaves that fewer documents reach can't recur and stop at the tree.  The places after
the leading tokens are dealt to one block more than a template may have fields, so all
lines of a template agree on a block at least.  A leaf's distinct lines gather once for
each block, among those that agree on it, in falling order of how common they are; a
line is dropped if one of its templates recurs.  A leaf of up to ``GROUP`` lines does
that in one task; a larger one is dealt out by block, with the same result.

Defined cases: null counts as empty and has no lines; lines without a token stay; rows that repeat both id and text are one document, and
all lose the same lines; a text whose lines all go becomes empty; an empty table gives
an empty result; other columns are ignored by ``line_report`` and returned unchanged by
``drop_template_lines``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idlecost.llm.common import full_text, stored, table

DEPTH = 3
SIMILARITY = 0.7
MIN_DOCS = 5
SHORT, LONG = 4, 20
MORE = 4
GROUP = 4096
WHOLE = -1
FIELD = "<*>"
_FIELD, _DIGIT = FIELD.encode(), re.compile(rb"[0-9]+")


def _row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"), full_text(text_col))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, line, leaf, weak, masked of every line with a token; tokens are parted by ASCII white space.

    ``weak`` lines are the short ones and those mostly of digits.
    """
    found: list[tuple[int, int, int, bool, str]] = []

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "row": pa.array([x[0] for x in found], pa.int64()), "line": pa.array([x[1] for x in found], pa.int32()),
            "leaf": pa.array([x[2] for x in found], pa.int64()), "weak": pa.array([x[3] for x in found], pa.bool_()),
            "masked": pa.array([x[4] for x in found], pa.string())})

    for batch in batches:
        for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for i, line in enumerate(text.encode().split(b"\n")):
                tokens = line.split()
                if not tokens:
                    continue
                weak = len(tokens) < SHORT
                if _DIGIT.search(line):
                    masked = [_FIELD if _DIGIT.search(t) else t for t in tokens]
                    if 2 * masked.count(_FIELD) > len(tokens):
                        weak, masked = True, [_DIGIT.sub(_FIELD, t) for t in tokens]
                    tokens = masked
                leaf = xxhash.xxh64_intdigest(b" ".join([b"%d" % len(tokens), *tokens[:DEPTH]])) >> 1
                found.append((row, i, leaf, weak, b" ".join(tokens).decode()))
            if len(found) >= 20_000:
                yield done()
                found = []
    if found:
        yield done()


def _long_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, line, said: a hash of the words of every line of ``LONG`` tokens or more."""
    for batch in batches:
        found = [(row, i, xxhash.xxh64_intdigest(b" ".join(tokens)) >> 1)
                 for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True)
                 for i, tokens in enumerate(x.split() for x in text.encode().split(b"\n")) if len(tokens) >= LONG]
        yield pa.RecordBatch.from_pydict({c: pa.array([f[k] for f in found], t) for k, (c, t) in enumerate(
            [("row", pa.int64()), ("line", pa.int32()), ("said", pa.int64())])})


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(_row_key(id_col, text_col).alias("row"), full_text(text_col).alias("text"))


def _leaves(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, line, leaf, weak, masked: the lines of every text with their leaf of the tree."""
    return _rows(docs, id_col, text_col).mapInArrow(_parsed, "row long, line int, leaf long, weak boolean, masked string")


def _copied_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, line: the long lines that another document has word for word, but for those of one document."""
    lines = stored(_rows(docs, id_col, text_col).mapInArrow(_long_lines, "row long, line int, said long"), "long-lines")
    first = lines.groupBy("said").agg(F.min("row").alias("_first"), F.max("row").alias("_last")).where("_first <> _last")
    return lines.join(first.select("said", "_first"), "said").where("row <> _first").select("row", "line")


def templates(lines: list[list[str]], similarity: float = SIMILARITY) -> list[str]:
    """The template of each token list of one leaf (all of one length)."""
    if len(lines) == 1:
        return [" ".join(lines[0])]
    codes: dict[str, int] = {FIELD: 0}
    rows = np.array([[codes.setdefault(t, len(codes)) for t in line] for line in lines], dtype=np.int64)
    made = np.empty_like(rows)
    n, to = 0, np.empty(len(rows), dtype=np.int64)
    for i, row in enumerate(rows):
        if n:
            agree = (made[:n] == row).sum(axis=1)  # a variable field agrees with a variable field only
            best = int(agree.argmax())
            if agree[best] >= similarity * rows.shape[1]:
                made[best][made[best] != row] = 0
                to[i] = best
                continue
        made[n], to[i] = row, n
        n += 1
    names = list(codes)
    said = [" ".join(names[c] for c in made[k].tolist()) for k in range(n)]
    return [said[k] for k in to.tolist()]


def _blocks(tokens: list[str], similarity: float = SIMILARITY) -> list[tuple[str, ...]]:
    """The block number and tokens of each block: lines that could share a template agree on one."""
    n = len(tokens) - math.ceil(similarity * len(tokens)) + 1
    return [(str(b), *tokens[DEPTH + b::n]) for b in range(n)]


def block_templates(lines: list[list[str]]) -> set[tuple[int, str]]:
    """(line, template) of all blocks of one leaf; a line that nothing joins is its own template."""
    found = {(i, " ".join(line)) for i, line in enumerate(lines)}
    alike: dict[tuple[str, ...], list[int]] = {}
    for i, line in enumerate(lines):
        for block in _blocks(line):
            alike.setdefault(block, []).append(i)
    for members in alike.values():
        if len(members) > 1:
            found.update(zip(members, templates([lines[i] for i in members]), strict=True))
    return found


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """leaf, group, masked, seen: each line of a large leaf once for each block, the group being a hash of the block."""
    for batch in batches:
        rows = [(leaf, xxhash.xxh64_intdigest("\x00".join(block).encode()) >> 1, masked, seen)
                for leaf, masked, seen in zip(*(batch.column(c).to_pylist() for c in ("leaf", "masked", "seen")), strict=True)
                for block in _blocks(masked.split(" "))]
        yield pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(
            [("leaf", pa.int64()), ("group", pa.int64()), ("masked", pa.string()), ("seen", pa.int64())])})


def _templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """leaf, masked, template; rows come sorted by leaf and group, one group is held.

    Group ``WHOLE`` is a leaf with all its blocks, another group one block of a leaf.
    """
    held: list[tuple[int, int, str]] = []

    def done() -> pa.RecordBatch:
        lines = [h[2].split(" ") for h in held]
        if held[0][1] == WHOLE:
            found = sorted(block_templates(lines))
        else:
            found = [(i, t) for i, t in enumerate(templates(lines)) if t != held[i][2]]
        return pa.RecordBatch.from_pydict({
            "leaf": pa.array([held[0][0]] * len(found), pa.int64()), "masked": pa.array([held[i][2] for i, _ in found], pa.string()),
            "template": pa.array([t for _, t in found], pa.string())})

    for batch in batches:
        for leaf, group, masked in zip(*(batch.column(c).to_pylist() for c in ("leaf", "group", "masked")), strict=True):
            if held and held[-1][:2] != (leaf, group):
                yield done()
                held = []
            held.append((leaf, group, masked))
    if held:
        yield done()


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, lines: the places of the lines of recurring templates in each text that has any."""
    lines = _leaves(docs, id_col, text_col)
    reached = lines.select("leaf", "weak", "row").distinct().groupBy("leaf").agg(F.count("*").alias("count"), F.min("weak").alias("weak"))
    reached = reached.where(F.col("count") >= F.when(F.col("weak"), MORE * min_docs).otherwise(min_docs)).select("leaf")
    lines = stored(lines.join(stored(reached, "leaves"), "leaf", "left_semi"), "leaf-lines")
    distinct = stored(lines.groupBy("leaf", "masked").agg(F.count("*").alias("seen")), "distinct-lines")
    large = stored(distinct.groupBy("leaf").count().where(F.col("count") > GROUP).select("leaf"), "large-leaves")
    hot = distinct.join(large, "leaf", "left_semi")
    dealt = distinct.join(large, "leaf", "left_anti").select("leaf", F.lit(WHOLE).cast("long").alias("group"), "masked", "seen").unionByName(
        hot.mapInArrow(_dealt, "leaf long, group long, masked string, seen long"))
    dealt = dealt.repartition("leaf", "group").sortWithinPartitions("leaf", "group", F.desc("seen"), "masked")
    found = dealt.mapInArrow(_templates, "leaf long, masked string, template string")
    found = stored(found.unionByName(hot.select("leaf", "masked", F.col("masked").alias("template"))).distinct(), "templates")
    placed = lines.join(found.select("leaf", "masked", F.xxhash64("template").alias("template")), ["leaf", "masked"])
    placed = stored(placed.select("row", "line", "weak", "template"), "template-lines")
    recur = placed.groupBy("template", "row").agg(F.max("weak").alias("weak")).groupBy("template").agg(F.count("*").alias("count"), F.max("weak").alias("weak"))
    recur = recur.where(F.col("count") >= F.when(F.col("weak"), MORE * min_docs).otherwise(min_docs)).select("template")
    gone = placed.join(recur, "template", "left_semi").select("row", "line")
    gone = gone.unionByName(_copied_lines(docs, id_col, text_col)).distinct()
    return gone.groupBy("row").agg(F.collect_list("line").alias("_lines")).withColumnRenamed("row", "_row")


def _without(text: str, lines: list[int] | None) -> tuple[int, str]:
    """Number of lines dropped and the text without them."""
    if not lines:
        return 0, text
    drop = set(lines)
    return len(drop), "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [_without(t, x) for t, x in zip(batch.column("_text").to_pylist(), batch.column("_lines").to_pylist(), strict=True)]
        names = [n for n in batch.schema.names if n not in ("_text", "_lines", "_row")]
        yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in names}
                                         | {"_dropped": pa.array([n for n, _ in out], pa.int64()), "_clean": pa.array([t for _, t in out], pa.string())})


def _marked(docs: DataFrame, keep: list[Column], min_docs: int, id_col: str, text_col: str) -> DataFrame:
    gone = stored(recurring_lines(docs, min_docs, id_col, text_col), "dropped-lines")
    texts = docs.select(*keep, _row_key(id_col, text_col).alias("_row"), full_text(text_col).alias("_text"))
    # The dropped lines grow with the corpus: they are merged at every size, never broadcast.
    rows = texts.join(gone.hint("merge"), "_row", "left")
    kept = [f for f in rows.schema.fields if f.name not in ("_text", "_lines", "_row")]
    return rows.mapInArrow(_cleaned, T.StructType([*kept, T.StructField("_dropped", T.LongType()), T.StructField("_clean", T.StringType())]))


def line_report(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped_lines, kept_chars, clean_sha256 of every row of ``docs``."""
    n = F.length(full_text(text_col)) - F.length(F.replace(full_text(text_col), F.lit("\n"), F.lit(""))) + 1
    n = F.when(full_text(text_col) == "", 0).otherwise(n)
    rows = _marked(docs, [F.col(id_col).alias("doc_id"), n.cast("long").alias("n_lines")], min_docs, id_col, text_col)
    return rows.select("doc_id", "n_lines", F.col("_dropped").alias("n_dropped_lines"), F.length("_clean").cast("long").alias("kept_chars"),
                       F.sha2("_clean", 256).alias("clean_sha256"))


def drop_template_lines(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines of recurring templates taken out of ``text_col``."""
    # The caller's row travels as one column, whatever its columns are called.
    rows = _marked(docs, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")], min_docs, id_col, text_col)
    own = {c: F.col("doc").getField(c) for c in docs.columns}
    own[text_col] = F.when(F.col("_dropped") > 0, F.col("_clean")).otherwise(own[text_col])
    return rows.select(*[own[c].alias(c) for c in docs.columns])


def sha256_without(text: str, lines: list[int]) -> str:
    return hashlib.sha256(_without(text, lines)[1].encode()).hexdigest()


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))
