"""Joining the texts of a group in order when the group may be too large for one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..storage import materialize

PART_BYTES = 32 << 20
RANGE_BYTES = 64 << 20
# What a row weighs besides its text, so that many short texts do not make a large part.
ROW_BYTES = 64


def _joined(order: list[str], sep: str):
    rows = F.array_sort(F.collect_list(F.struct(*order, "_text")))
    return F.array_join(F.transform(rows, lambda r: r["_text"]), sep)


def ordered_text(df: DataFrame, keys: list[str], order: list[str], text: str, sep: str = "",
                 part_bytes: int = PART_BYTES) -> DataFrame:
    """Concatenate ``text`` per group in ``order`` into parts: ``keys``, ``part_no``, ``text``.

    The parts of a group, concatenated by ``part_no``, are exactly its texts joined by ``sep``. A
    row weighs the bytes of its text and separator and ``ROW_BYTES``, and goes to the part that the
    weight before it falls in. So a part weighs at most ``part_bytes`` plus one row, and the result
    does not depend on the partitioning.

    Groups are weighed first. Those that fit one part are aggregated directly. For the others rows
    are range-partitioned, each range sums its own weights and the ranges' totals give every row
    its offset, so a group of any size is spread over the cluster.
    """
    rows = materialize(df.select(*keys, *order, F.col(text).alias("_text")), "texts").withColumn(
        "_bytes", F.octet_length("_text").cast("bigint") + len(sep.encode()) + ROW_BYTES
    )
    sizes = rows.groupBy(*keys).agg(F.sum("_bytes").alias("_total"))
    large_keys = sizes.filter(F.col("_total") > part_bytes)
    total = large_keys.agg(F.sum("_total")).first()[0]
    if total is None:
        return _small(rows, keys, order, sep)
    large_keys = materialize(large_keys, "large-groups")
    small = rows.join(large_keys.select(*keys), keys, "left_anti")
    large = rows.join(large_keys.select(*keys), keys, "left_semi")
    return _small(small, keys, order, sep).unionByName(_large(large, total, keys, order, sep, part_bytes))


def _small(rows: DataFrame, keys: list[str], order: list[str], sep: str) -> DataFrame:
    return rows.groupBy(*keys).agg(_joined(order, sep).alias("text")).select(
        *keys, F.lit(0).cast("bigint").alias("part_no"), "text"
    )


def _large(rows: DataFrame, total: int, keys: list[str], order: list[str], sep: str, part_bytes: int) -> DataFrame:
    # The text breaks ties, so equal order values cannot change the result. Rows with equal keys and order
    # lie in one range, so the ranges need no texts, which Spark would sample to the driver.
    sort = [*order, "_text"]
    ranges = max(8, total // RANGE_BYTES + 1)
    # Written once: the offsets below need every reader to see the same ranges.
    ranged = materialize(
        rows.repartitionByRange(ranges, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    totals = ranged.groupBy(*keys, "_range").agg(F.sum("_bytes").alias("_range_bytes"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select(*keys, "_range", F.coalesce(F.sum("_range_bytes").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy(*keys, "_range").orderBy(*sort).rowsBetween(W.unboundedPreceding, -1)
    placed = (
        ranged.withColumn("_local", F.coalesce(F.sum("_bytes").over(inside), F.lit(0)))
        .join(bases, [*keys, "_range"])
        .withColumn("_offset", F.col("_base") + F.col("_local"))
        .withColumn("part_no", F.expr(f"_offset div {part_bytes}"))
    )
    parts = placed.groupBy(*keys, "part_no").agg(
        _joined(order, sep).alias("_body"), F.min("_offset").alias("_first")
    )
    return parts.select(
        *keys, "part_no",
        F.when(F.col("_first") > 0, F.concat(F.lit(sep), "_body")).otherwise(F.col("_body")).alias("text"),
    )


def whole_texts(parts: DataFrame, keys: list[str], text: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """Put the parts of each group together: ``keys``, ``text`` and the columns ``carried``, equal in all parts.

    For a reader that needs a whole text at once, as a model does; its row holds it, whatever its size.
    """
    rows = F.array_sort(F.collect_list(F.struct("part_no", text)))
    return parts.groupBy(*keys).agg(
        F.array_join(F.transform(rows, lambda p: p[text]), "").alias(text), *[F.first(c).alias(c) for c in carried]
    )
