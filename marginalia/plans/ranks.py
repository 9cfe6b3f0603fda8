"""Places of rows in groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..storage import materialize


def with_place(df: DataFrame, group: list[str], order: list[str], name: str, label: str = "ranked") -> DataFrame:
    """Add the place of each row in its group, from 1, by ``order``; no task holds a group.

    Rows are range-partitioned and written once; a range counts its rows of each group, and the counts of
    the ranges before it are added to the place in the range. Group columns must not be NULL.
    """
    spark = df.sparkSession
    shards = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(shards, *group, *order).sortWithinPartitions(*group, *order)
    rows = materialize(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), label)
    parts = rows.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    # One row per range of a group.
    before = F.sum("_n").over(W.partitionBy(*group).orderBy("_part")) - F.col("_n")
    shifts = parts.select(*group, "_part", (before - F.col("_first") + 1).alias("_shift"))
    return rows.join(shifts, [*group, "_part"]).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(name))
