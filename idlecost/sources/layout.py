"""A statement log laid out so that attribution needs no shuffle.

The log is a catalog table partitioned by ``date`` and bucketed by (cluster_id, salt).  The
salt is 0 but for hot clusters: one that holds more than a piece, ``1 / PIECES`` of a bucket's
share of all statements, is dealt over as many salts as it has pieces, by a hash of the
statement.  So every (cluster, salt) is a small part of a bucket.  ``<table>_salts`` names the hot
clusters -- fewer than ``PIECES`` for each bucket, by the definition of hot.  The map of the
analysed clusters gets a row for each salt of a cluster and the same buckets, so that
bucket meets bucket whatever the map's size is, and no task holds a hot cluster.

New days are appended with the salts that the table was made with.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idlecost.session import stored, stored_bucketed
from idlecost.sources.schemas import require_columns

SALT = "salt"
PIECES = 4
BUCKET_COLUMNS = ["cluster_id", SALT]


class Layout(NamedTuple):
    """How a statement table is bucketed: (cluster_id, salts) of its hot clusters, and its buckets."""

    salts: DataFrame
    buckets: int


def hot_clusters(statements: DataFrame, buckets: int) -> DataFrame:
    """(cluster_id, salts) of the clusters that hold more than a piece of a bucket's share of the statements."""
    counts = stored(statements.groupBy("cluster_id").agg(F.count("*").alias("n")), "cluster-sizes")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    piece = max(1, -(-total // (buckets * PIECES)))
    return counts.where((F.col("n") > piece) & F.col("cluster_id").isNotNull()).select(
        "cluster_id", F.ceil(F.col("n") / piece).cast("int").alias("salts"))


def _salted(statements: DataFrame, salts: DataFrame) -> DataFrame:
    """``statements`` with their salt; ``salts`` has fewer rows than ``PIECES`` times the table's buckets."""
    joined = statements.join(F.broadcast(salts), "cluster_id", "left")
    return joined.withColumn(SALT, F.pmod(F.xxhash64("statement_id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")


def _write(statements: DataFrame, table: str, buckets: int, salts: DataFrame, mode: str, path: str | None) -> None:
    # Spark's shuffle and its buckets use one hash: each task writes one bucket, one file a day.
    writer = (_salted(statements, salts).repartition(buckets, *BUCKET_COLUMNS).write.mode(mode).format("parquet")
              .partitionBy("date").bucketBy(buckets, *BUCKET_COLUMNS).sortBy(*BUCKET_COLUMNS))
    (writer.option("path", path) if path else writer).saveAsTable(table)


def write_statement_log(statements: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Write ``statements`` as the bucketed catalog table ``table`` and its hot clusters as ``<table>_salts``.

    About 128 MB of statements of a day a bucket is a good size.  ``path``: where the
    files go, if not to the warehouse.
    """
    require_columns(statements, "statements")
    salts = stored(hot_clusters(statements, buckets), "salts")
    writer = salts.write.mode("overwrite").format("parquet")
    (writer.option("path", f"{path}_salts") if path else writer).saveAsTable(f"{table}_salts")
    _write(statements, table, buckets, salts, "overwrite", path)


def append_statements(statements: DataFrame, table: str) -> None:
    """Add ``statements`` (new days) to a table of ``write_statement_log``."""
    spark = statements.sparkSession
    layout = layout_of(spark, table)
    if layout is None:
        raise ValueError(f"{table} is not a table of write_statement_log")
    columns = [c for c in spark.table(table).columns if c != SALT]
    _write(statements.select(*columns), table, layout.buckets, layout.salts, "append", None)


def layout_of(spark: SparkSession, table: str) -> Layout | None:
    """The layout of a catalog table, None for a table that isn't bucketed by cluster and salt."""
    said = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
    columns = [c.strip(" `") for c in said.get("Bucket Columns", "").strip("[]").split(",")]
    if columns != BUCKET_COLUMNS:
        return None
    return Layout(spark.table(f"{table}_salts"), int(said["Num Buckets"]))


def salted_map(clusters: DataFrame, layout: Layout) -> DataFrame:
    """``clusters`` with a row for each salt of its cluster, stored in the log's buckets."""
    many = clusters.join(F.broadcast(layout.salts), "cluster_id", "left")
    many = many.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return stored_bucketed(many, "salted-clusters", layout.buckets, BUCKET_COLUMNS)
