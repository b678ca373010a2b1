"""Small frames for hand examples (tests only)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

US = 1_000_000
T0 = int(dt.datetime(2024, 1, 10, tzinfo=dt.timezone.utc).timestamp()) * US  # a midnight


def intervals_df(spark, rows, extra_cols=()):
    """rows: (cluster_id, start_s, end_s[, extras...]) with seconds relative to T0."""
    fields = [T.StructField("cluster_id", T.LongType()), T.StructField("start_us", T.LongType()),
              T.StructField("end_us", T.LongType())]
    fields += [T.StructField(c, T.LongType()) for c in extra_cols]
    data = [(r[0], T0 + round(r[1] * US), T0 + round(r[2] * US), *r[3:]) for r in rows]
    return spark.createDataFrame(data, T.StructType(fields))


def idle_sessions_plain(statements: DataFrame, gap_us: int, partition_by: list[str], group_by: list[str]) -> DataFrame:
    """The textbook window form (running max, flag, running sum), for tests only:
    it sorts each partition key on one task, which does not scale under skew."""
    part = list(partition_by)
    keys = part + [g for g in group_by if g not in part]
    w = (Window.partitionBy(*part) if part else Window).orderBy("start_us", "end_us")
    df = statements.withColumn("_prev", F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    flag = F.when(F.col("_prev").isNull() | (F.col("start_us") - F.lit(gap_us) > F.col("_prev")), 1).otherwise(0)
    df = df.withColumn("_sid", F.sum(flag).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*keys, "_sid").agg(
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count(F.lit(1)).alias("statements")
    ).drop("_sid")
