"""Spark session settings the operators rely on, and tables in the shared folder.

All day arithmetic is done on UTC epoch microseconds; the session time zone is
pinned to UTC so that ``timestamp_ntz`` inputs convert without a shift.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at any scale.  Partition counts are left to AQE, which
# coalesces small shuffles and splits skewed join partitions at run time.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Spark broadcasts a join side only when its measured size is below these.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def scale_conf(statement_bytes: int, executors_cores: int, target_partition_bytes: int = 128 * 1024 ** 2) -> dict[str, str]:
    """Settings for a cluster run, from the size of the statement log in the date range.

    The widest shuffle is the session cells by (cluster, cell); it gets about
    ``target_partition_bytes`` per partition, and never fewer partitions than
    cores.  AQE coalesces small shuffles down from this and splits skewed join
    partitions; scans split files at the same size.
    """
    partitions = max(executors_cores, -(-statement_bytes // target_partition_bytes))
    return {
        **SESSION_CONF,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
    }


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "idlecost") -> SparkSession:
    """A local session for tests and the bench (UI off, UTC, AQE on)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("IDLECOST_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def check_session(spark: SparkSession) -> None:
    """Raise if the session time zone is not UTC (day cuts assume UTC days)."""
    tz = spark.conf.get("spark.sql.session.timeZone")
    if tz not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"spark.sql.session.timeZone must be UTC, not {tz!r}")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``.

    Only a local session without that setting (tests, the bench) gets one of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="idlecost-shared-"))
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a small intermediate as a table in the shared folder and read it back.

    Its size is then known to the planner, which broadcasts it where it is below the
    session's threshold and joins it otherwise, and a lost executor reads it again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/idlecost-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_bucketed(df: DataFrame, name: str, buckets: int, columns: list[str]) -> DataFrame:
    """The same as a table bucketed and sorted by ``columns``; its files lie in the shared folder, too."""
    spark = df.sparkSession
    own = f"idlecost-{name}-{uuid.uuid4().hex}"
    (df.repartition(buckets, *columns).write.format("parquet").bucketBy(buckets, *columns).sortBy(*columns)
     .option("path", f"{shared_dir(spark)}/{own}").saveAsTable(own.replace("-", "_")))
    return spark.table(own.replace("-", "_"))
