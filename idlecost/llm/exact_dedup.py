"""Exact dedup by content sort.

Sampled splitters (Spark's range partitioner) deal the normalised texts out, an
external sort places equal texts next to each other, and neighbours are compared in
full.  The sampled key is small whatever the texts are: the text's first
``KEY_POINTS`` code points, its 64-bit hash, its length and the id.  As it holds more
than the text, a group of copies of any size spreads over as many partitions as its
rows need; the runs that touch a partition's border are joined afterwards by
comparing each border's two texts, two small rows a partition.

Defined cases: a null text counts as empty; all empty texts are one group; of
equal texts the longest original, then the smallest id stays (a null id sorts
last); of rows that agree in all of that exactly one stays; an empty table gives
an empty result; other columns are ignored by ``content_groups`` and returned
unchanged by ``exact_dedup``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from idlecost.llm.common import SPACE_CLASS, full_text, stored, table, with_ids, without_ids

FIRST_RUN, LAST_RUN = 1, 2
KEY_POINTS = 32


def normalised(col: str = "text"):
    """The text without any white space."""
    return F.regexp_replace(full_text(col), f"[{SPACE_CLASS}]+", "")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbours of one sorted partition.

    Keeps numbers only (ids, lengths, run numbers) and the digest of each run;
    texts are held for one batch, and for the partition's first and last run.
    """
    ids, points, run_of, starts, digests = [], [], [], [], []
    last = first_text = None
    runs = 0
    id_type = pa.int64()
    for batch in batches:
        if not batch.num_rows:
            continue
        norm, id_type = batch.column("norm"), batch.column("doc_id").type
        same = np.zeros(batch.num_rows, dtype=bool)
        same[0] = last is not None and norm[0].as_py() == last
        same[1:] = pc.equal(norm[1:], norm[:-1]).to_numpy(zero_copy_only=False)
        new = np.flatnonzero(~same)
        for i in new:
            digests.append(hashlib.sha256(norm[int(i)].as_py().encode()).hexdigest())
        if first_text is None:
            first_text = norm[0].as_py()
        last = norm[batch.num_rows - 1].as_py()
        run_of.append(runs - 1 + np.cumsum(~same))
        runs += len(new)
        starts.append(~same)
        ids.append(batch.column("doc_id"))
        points.append(batch.column("n_points").to_numpy())
    if not runs:
        return
    run, start = np.concatenate(run_of), np.concatenate(starts)
    first_row = np.flatnonzero(start)
    all_ids = pa.chunked_array(ids, type=id_type).combine_chunks()
    edge = np.where(run == 0, FIRST_RUN, 0) + np.where(run == runs - 1, LAST_RUN, 0)
    text = np.full(len(run), None, dtype=object)
    text[first_row[0]], text[first_row[-1]] = first_text, last
    yield pa.RecordBatch.from_pydict({
        "doc_id": all_ids,
        "n_points": pa.array(np.concatenate(points)),
        "keep_id": all_ids.take(pa.array(first_row[run])),
        "group_size": pa.array(np.bincount(run)[run].astype("int64")),
        "head": pa.array(start),
        "text_sha256": pa.array(digests, pa.string()).take(pa.array(run)),
        "part": pa.array(np.full(len(run), TaskContext.get().partitionId(), dtype="int32")),
        "edge": pa.array(edge.astype("int32")),
        "edge_text": pa.array(text, pa.string()),
    })


def _border_runs(rows: DataFrame) -> DataFrame:
    """The runs at partition borders, joined over equal neighbours: (part, edge) ->
    group size, kept id, and the run whose first row stays.

    At most two rows a partition go through the unpartitioned windows, without
    their texts; each border's two texts meet in an equi-join.
    """
    runs = rows.where("head AND edge > 0").select(
        "part", "edge", "group_size", "n_points", "keep_id", "edge_text", F.col("edge").bitwiseAND(1).alias("_first"))
    order = Window.orderBy("part", F.desc("_first"))
    narrow = runs.drop("edge_text").withColumn("_at", F.row_number().over(order))
    texts = runs.select("part", "edge", "edge_text")
    keyed = narrow.join(texts, ["part", "edge"])
    before = keyed.select((F.col("_at") + 1).alias("_at"), F.col("edge_text").alias("_text_before"))
    linked = keyed.join(before, "_at", "left").select(
        *narrow.columns, F.when(F.col("edge_text") == F.col("_text_before"), 0).otherwise(1).alias("_new"))
    grouped = linked.withColumn("_group", F.sum("_new").over(Window.orderBy("_at")))
    of_group = Window.partitionBy("_group")
    best = of_group.orderBy(F.desc("n_points"), F.asc_nulls_last("keep_id"), "_at")
    return grouped.select(
        "part", "edge", F.sum("group_size").over(of_group).alias("_size"), F.first("keep_id").over(best).alias("_keep"),
        (F.row_number().over(best) == 1).alias("_stays"))


def content_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs``."""
    keys = docs.select(F.col(id_col).alias("doc_id"), F.length(full_text(text_col)).cast("long").alias("n_points"),
                       normalised(text_col).alias("norm"))
    head, tail = [F.asc("_start"), F.asc("_hash")], [F.desc("n_points"), F.asc_nulls_last("doc_id")]
    id_type = keys.schema["doc_id"].dataType.simpleString()
    keys = keys.withColumns({"_start": F.substring("norm", 1, KEY_POINTS), "_hash": F.xxhash64("norm")})
    rows = keys.repartitionByRange(*head, *tail).sortWithinPartitions(*head, F.asc("norm"), *tail).mapInArrow(
        _runs, f"doc_id {id_type}, n_points long, keep_id {id_type}, group_size long, head boolean, "
               "text_sha256 string, part int, edge int, edge_text string")
    rows = stored(rows, "content-runs")
    # Stored, so that Spark knows its size and broadcasts it or not; runs inside a partition need no join.
    fixed = stored(_border_runs(rows), "border-runs")
    inner = rows.where("edge = 0").select("doc_id", "keep_id", "group_size", F.col("head").alias("kept"), "text_sha256")
    border = rows.where("edge > 0").drop("edge_text").join(fixed, ["part", "edge"]).select(
        "doc_id", F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
        (F.col("head") & F.col("_stays")).alias("kept"), "text_sha256")
    return inner.unionByName(border)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all their columns unchanged."""
    groups = stored(content_groups(docs, id_col, text_col).select("doc_id", "kept", "text_sha256"), "content-groups")
    gone = groups.where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    kept = groups.where("kept").select(F.col("doc_id").alias("_kept"), F.col("text_sha256").alias("_sha"))
    main = without_ids(docs, id_col, gone)
    # An id with rows on both sides: repeated ids, or rows repeated as they are.
    both = stored(gone.join(kept.select("_kept").distinct(), F.col("_gone").eqNullSafe(F.col("_kept"))).select("_gone"), "doubtful-ids")
    if both.isEmpty():
        return main
    repeated = with_ids(docs, id_col, both).withColumn("_own_sha", F.sha2(normalised(text_col), 256))
    nth = Window.partitionBy(id_col, "_own_sha").orderBy(F.desc(F.length(full_text(text_col))),
                                                         *[F.col(f"`{c}`").cast("string") for c in docs.columns])
    one = repeated.withColumn("_nth", F.row_number().over(nth)).where("_nth = 1")
    stay = one.join(kept, F.col(id_col).eqNullSafe(F.col("_kept")) & (F.col("_own_sha") == F.col("_sha")), "left_semi")
    return main.unionByName(stay.select(*docs.columns))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_groups(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
r AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER w AS keep_id, row_number() OVER w = 1 AS kept
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY n_points DESC, doc_id))
SELECT doc_id, keep_id, group_size, kept, sha256(norm) AS text_sha256 FROM r
"""
