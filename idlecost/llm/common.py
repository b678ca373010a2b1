"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of the contracts, as a regular expression class and as characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_BYTES = b" \t\n\x0b\x0c\r"


_shipped: set[str] = set()

#: Rows of an Arrow batch, where the session has Spark's default of 10,000: texts have kilobytes, and
#: each task holds a batch in the JVM, another on its way and two in its Python worker.
ARROW_ROWS, DEFAULT_ARROW_ROWS = 1000, 10_000
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers once a session (as ``--py-files`` would),
    so that they can import it wherever the session was started."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    if int(spark.conf.get(_ARROW)) == DEFAULT_ARROW_ROWS:
        spark.conf.set(_ARROW, str(ARROW_ROWS))
    package = Path(__file__).resolve().parents[1]
    path = f"{tempfile.mkdtemp(prefix='llm-code-')}/{package.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="llm-shared-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor re-reads the table, and whatever used
    several results of ``df`` sees the same rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def full_text(col: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def lowest_by_hash(rows: DataFrame, group: str, id_col: str, n: int, parts: int = 64) -> DataFrame:
    """The ``n`` rows of each group lowest in a hash order of the id.

    Taken from the lowest ``n`` of each of ``parts`` parts of a group, so that no task
    gets more than ``n * parts`` rows or a part of a group.
    """
    order = [F.xxhash64(F.col(id_col).cast("string")), F.col(id_col)]
    part = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("part")), F.lit(parts))
    some = rows.withColumn("_part", part).withColumn("_n", F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)))
    some = some.where(F.col("_n") <= n).withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return some.where(F.col("_n") <= n).drop("_part", "_n")


#: Bits an id in the map of ``without_ids``, and its words of 64 bits at least and at most (16 MB of rows).
MAP_BITS, LEAST_WORDS, MOST_WORDS = 16, 1 << 10, 1 << 20


def map_words(n: int) -> int | None:
    """Words of the map of ``n`` ids, a power of two; None where it would take more than ``MOST_WORDS``."""
    words = max(LEAST_WORDS, 1 << max(0, -(-n * MAP_BITS // 64) - 1).bit_length())
    return words if words <= MOST_WORDS else None


def _by_map(docs: DataFrame, id_col: str, ids: DataFrame) -> tuple[DataFrame | None, DataFrame, DataFrame, bool]:
    """The rows of ``docs`` whose id is surely not in the one column of ``ids`` (None: no map), the other
    rows with an id, the stored ids, and whether null is one of them.

    A bit map of the hashed ids tells for most rows that their id is not among them, without moving
    their texts.  Its size follows the number of ids; up to ``MOST_WORDS`` it is broadcast, beyond
    there is none and all rows with an id are left to a join.  Rows with a null id need neither:
    they all share its fate.
    """
    ids = stored(ids.select(ids[ids.columns[0]].alias("_gone")).distinct(), "gone")
    n, nulls = ids.agg(F.count("*"), F.count_if(F.col("_gone").isNull())).first()
    words = map_words(n)
    own = docs[f"`{id_col}`"]
    if words is None:
        return None, docs.where(own.isNotNull()), ids, nulls > 0

    def place(column: Column) -> Column:
        return F.pmod(F.xxhash64(column.cast("string")), F.lit(words * 64))

    def word(column: Column) -> Column:
        return F.call_function("div", place(column), F.lit(64))

    def bit(column: Column) -> Column:
        return (place(column) % 64).cast("int")

    bits = ids.select(word(ids["_gone"]).alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit(ids["_gone"])).alias("_bit"))
    bits = stored(bits.groupBy("_word").agg(F.bit_or("_bit").alias("_bits")), "gone-map")
    marked = docs.join(F.broadcast(bits), word(own) == bits["_word"], "left")
    is_set = F.coalesce(F.call_function("shiftrightunsigned", bits["_bits"], bit(own)) % 2, F.lit(0)) != 0
    columns = [docs[f"`{c}`"] for c in docs.columns]
    return (marked.where(own.isNotNull() & ~is_set).select(*columns), marked.where(own.isNotNull() & is_set).select(*columns),
            ids, nulls > 0)


def without_ids(docs: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id (null is an id, too) is not in the one column of ``gone``.

    Only rows whose bit is set in the map of the ids meet the ids in a join.
    """
    sure, maybe, gone, null_goes = _by_map(docs, id_col, gone)
    rows = maybe.join(gone, maybe[f"`{id_col}`"] == gone["_gone"], "left_anti")
    if sure is not None:
        rows = sure.unionByName(rows)
    return rows if null_goes else rows.unionByName(docs.where(docs[f"`{id_col}`"].isNull()))


def with_ids(docs: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id (null is an id, too) is in the one column of ``ids``."""
    _, maybe, ids, null_stays = _by_map(docs, id_col, ids)
    rows = maybe.join(ids, maybe[f"`{id_col}`"] == ids["_gone"], "left_semi")
    return rows.unionByName(docs.where(docs[f"`{id_col}`"].isNull())) if null_stays else rows
