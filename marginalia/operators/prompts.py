"""Prompts for the model. A prompt that lists a whole project is built as parts of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import templates as tp
from ..plans.ordered_text import PART_BYTES, ordered_text

FUNCTION_KEY = ["project", "path", "name", "start_line", "end_line"]


def with_settings(df: DataFrame, system: str, tokens: int) -> DataFrame:
    return df.select(
        "*",
        F.lit(system).alias("system"),
        F.lit(tokens).cast("bigint").alias("max_tokens"),
        F.lit(tp.TEMPERATURE).alias("temperature"),
    )


def extract_prompt(chunks: DataFrame) -> DataFrame:
    """The extraction prompt of each chunk of numbered lines."""
    prompt = F.concat(F.lit(tp.EXTRACT_HEAD), "path", F.lit(tp.EXTRACT_MIDDLE), "content")
    return with_settings(chunks.withColumn("prompt", prompt).drop("content"), tp.EXTRACT_SYSTEM, tp.EXTRACT_TOKENS)


def seed_prompt(records: DataFrame, order: list[str], part_bytes: int = PART_BYTES) -> DataFrame:
    """One prompt per project with all its records in order, as parts ``project, part_no, text``."""
    lines = records.select("project", F.lit(1).alias("_rank"), *order, F.concat("record", F.lit("\n")).alias("text"))
    head = lines.select(
        "project", F.lit(0).alias("_rank"), *[F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in order],
        F.lit(tp.SEED_HEAD).alias("text"),
    ).distinct()
    parts = ordered_text(head.unionByName(lines), ["project"], ["_rank", *order], "text", "", part_bytes)
    return with_settings(parts, tp.SEED_SYSTEM, tp.SEED_TOKENS)


def review_prompt(functions: DataFrame, remaining: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """The review prompt of each function with its project's remaining keys in order, as parts.

    Every prompt repeats the list of its project, so give it the functions that are due now: the
    review walk has one per project, in a table written before, so that Catalyst sees its size and
    the keys, which are the large side, stay where they are.
    """
    due = functions.select(*FUNCTION_KEY, "content")
    text = lambda rank, key, body: due.select(
        *FUNCTION_KEY, F.lit(rank).alias("_rank"), F.lit(key).cast("string").alias("_key"), body.alias("text")
    )
    head = text(0, None, F.concat(F.lit(tp.REVIEW_HEAD), "content", F.lit(tp.REVIEW_PATH), "path", F.lit(tp.REVIEW_LIST)))
    tail = text(2, None, F.lit(tp.REVIEW_TAIL))
    keys = remaining.select("project", "key").join(due.select(*FUNCTION_KEY), "project").select(
        *FUNCTION_KEY, F.lit(1).alias("_rank"), F.col("key").alias("_key"), F.concat("key", F.lit("\n")).alias("text")
    )
    rows = head.unionByName(keys).unionByName(tail)
    parts = ordered_text(rows, FUNCTION_KEY, ["_rank", "_key"], "text", "", part_bytes)
    return with_settings(parts, tp.REVIEW_SYSTEM, tp.REVIEW_TOKENS)
