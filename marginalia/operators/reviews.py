"""Reading review messages and choosing what to review next."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx


def parse_reviews(df: DataFrame, message: str = "review_message") -> DataFrame:
    """Add the fields of the message: severity, review, continue flag, next name and path, part count.

    Missing severity and review text get the report defaults; the routing fields stay NULL.
    """
    part = lambda i: F.get("_parts", F.lit(i))
    return (
        df.withColumn("_parts", tx.review_parts(F.col(message)))
        .withColumn("severity", F.coalesce(part(1), F.lit(tx.DEFAULT_SEVERITY)))
        .withColumn("review", F.coalesce(part(2), F.lit(tx.DEFAULT_REVIEW)))
        .withColumn("continue_flag", part(3))
        .withColumn("next_name", part(4))
        .withColumn("next_path", part(5))
        .withColumn("n_parts", F.size("_parts").cast("bigint"))
        .drop("_parts")
    )


def suffix_index(index: DataFrame) -> DataFrame:
    """Every (suffix after a colon, key) of the index: the equality form of an ``ends with`` match."""
    return index.select("project", F.explode(tx.key_suffixes(F.col("key"))).alias("suffix"), "key", "path")


def smallest_by_suffix(suffixes: DataFrame) -> DataFrame:
    """One row per suffix with its smallest key; combined map-side, so a common name stays cheap."""
    return suffixes.groupBy("project", "suffix").agg(F.min(F.struct("key", "path")).alias("_s"))


def next_exact(parsed: DataFrame, index: DataFrame) -> DataFrame:
    """Reviews whose ``next_path:next_name`` is in the index, with that ``key``."""
    probe = parsed.withColumn("key", tx.index_key(F.col("next_path"), F.col("next_name")))
    target = index.select("project", "key", F.col("path").alias("key_path"))
    return probe.join(target, ["project", "key"])


def next_by_suffix(parsed: DataFrame, index: DataFrame) -> DataFrame:
    """Reviews for which some key ends with ``:next_name``, with the smallest such ``key``."""
    target = smallest_by_suffix(suffix_index(index)).select(
        "project", F.col("suffix").alias("next_name"), F.col("_s.key").alias("key"), F.col("_s.path").alias("key_path")
    )
    return parsed.join(target, ["project", "next_name"])


def next_signal(parsed: DataFrame, index: DataFrame) -> DataFrame:
    """Route each review: ``status``, the ``key`` taken from the index and the signal it sends.

    Both lookups are equality joins against a table with one row per key.
    """
    exact = index.select("project", F.col("key").alias("_probe"), F.col("path").alias("_exact_path"))
    near = smallest_by_suffix(suffix_index(index)).select("project", F.col("suffix").alias("next_name"), "_s")
    joined = (
        parsed.withColumn("_probe", tx.index_key(F.col("next_path"), F.col("next_name")))
        .join(exact, ["project", "_probe"], "left")
        .join(near, ["project", "next_name"], "left")
    )
    status = (
        F.when(F.col("n_parts") < tx.MIN_PARTS, "malformed")
        .when(F.col("continue_flag") != "1", "done")
        .when(F.col("_exact_path").isNotNull(), "exact")
        .when(F.col("_s").isNotNull(), "suffix")
        .otherwise("not_found")
    )
    pick = lambda exact_col, near_col: F.when(F.col("status") == "exact", exact_col).when(
        F.col("status") == "suffix", near_col
    )
    keep = [c for c in parsed.columns if c not in ("next_path",)]
    return (
        joined.withColumn("status", status)
        .withColumn("key", pick(F.col("_probe"), F.col("_s.key")))
        .withColumn("next_key", F.when(F.col("status").isin("exact", "suffix"), F.col("next_name")))
        .withColumn("next_path", pick(F.col("_exact_path"), F.col("_s.path")))
        .select(*keep, "status", "key", "next_key", "next_path")
    )


def remaining_functions(index: DataFrame, taken: DataFrame) -> DataFrame:
    """The index without the keys already taken."""
    return index.join(taken.select("project", "key"), ["project", "key"], "left_anti")


def remaining_map(functions: str, key: str):
    """The same inside one row: a map column without one key."""
    return F.map_filter(functions, lambda k, _: k != F.col(key))


def archive_reviews(df: DataFrame) -> DataFrame:
    """What the archive keeps of a review, malformed ones included."""
    return df.select("project", "name", "path", "start_line", "end_line", "review_message")
