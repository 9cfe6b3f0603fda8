"""Lines and chunks. All of it is narrow: a file row is split, numbered and packed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..storage import materialize

MAX_CHUNK_BYTES = 102_400


def split_lines(df: DataFrame) -> DataFrame:
    """One row per line with its 1-based ``line_no``; other columns are kept."""
    keep = [c for c in df.columns if c != "content"]
    # The outer form keeps Catalyst from computing the lines again in a filter it would infer.
    filled = df.filter(F.col("content") != "")
    return filled.select(*keep, F.posexplode_outer(tx.text_lines(F.col("content"))).alias("_pos", "line")).select(
        *keep, (F.col("_pos") + 1).cast("bigint").alias("line_no"), "line"
    )


def number_lines(df: DataFrame) -> DataFrame:
    return df.withColumn("numbered", tx.numbered_line(F.col("line_no"), F.col("line")))


def _chunk_starts(numbered, max_bytes: int):
    """0-based first lines of the chunks after the first one.

    The fold keeps the open chunk's size and appends only at a break, so it is linear in the lines.
    """
    start = F.struct(
        F.lit(0).alias("i"), F.lit(0).cast("bigint").alias("size"), F.array().cast("array<int>").alias("breaks")
    )

    def step(acc, line):
        n = F.octet_length(line).cast("bigint")
        full = (acc["i"] > 0) & (acc["size"] + n > max_bytes)
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(full, n).otherwise(acc["size"] + n).alias("size"),
            F.when(full, F.array_append(acc["breaks"], acc["i"])).otherwise(acc["breaks"]).alias("breaks"),
        )

    return F.aggregate(numbered, start, step, lambda acc: acc["breaks"])


def chunk_lines(df: DataFrame, max_bytes: int = MAX_CHUNK_BYTES) -> DataFrame:
    """Pack numbered lines greedily into chunks of at most ``max_bytes``; a longer line stands alone.

    Adds ``chunk_no`` (from 0), ``n_chunks`` of the file, ``first_line``, ``last_line`` and the
    chunk's ``content``. A file without lines gives no chunk.
    """
    keep = [c for c in df.columns if c != "content"]
    numbered = df.filter(F.col("content") != "").withColumn(
        "_numbered",
        F.transform(tx.text_lines(F.col("content")), lambda line, i: tx.numbered_line(i + 1, line)),
    ).drop("content")
    cut = numbered.withColumn(
        "_starts", F.concat(F.array(F.lit(0)), _chunk_starts(F.col("_numbered"), max_bytes))
    )
    chunks = cut.select(*keep, "_numbered", "_starts", F.posexplode_outer("_starts").alias("_no", "_start"))
    last = F.coalesce(F.get("_starts", F.col("_no") + 1), F.size("_numbered"))
    return chunks.select(
        *keep,
        F.col("_no").cast("bigint").alias("chunk_no"),
        F.size("_starts").cast("bigint").alias("n_chunks"),
        (F.col("_start") + 1).cast("bigint").alias("first_line"),
        last.cast("bigint").alias("last_line"),
        F.array_join(F.slice("_numbered", F.col("_start") + 1, last - F.col("_start")), "").alias("content"),
    )


def mark_last_chunk(chunks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Mark the last chunk of each project's last file with ``is_last``.

    The last file is the greatest path that has any text: an aggregate with one row per project,
    combined map-side. Given the ``files`` the chunks came from, it is found without chunking them
    a second time. It is written first, so that Catalyst sees its size and joins the chunk texts
    without a shuffle when it is small.
    """
    named = chunks if files is None else files.filter(F.col("content") != "")
    last = materialize(named.groupBy("project").agg(F.max("path").alias("_last")), "last-file")
    last_of_file = F.col("chunk_no") == F.col("n_chunks") - 1
    return (
        chunks.join(last, "project", "left")
        .withColumn("is_last", last_of_file & (F.col("path") == F.col("_last")))
        .drop("_last")
    )
