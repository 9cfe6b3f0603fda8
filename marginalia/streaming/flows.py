"""The three flows over growing input: files to chunks, reviews to reports, reviews to signals.

Each uses the operators of the batch side, so a stream that has seen everything equals the batch.
State between batches is kept in tables keyed by batch id in the folder of the flow: a batch that
runs again reads what the batches before it left and replaces its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import text as tx
from ..operators.lines import MAX_CHUNK_BYTES, chunk_lines
from ..operators.reports import assemble_reports, render_markdown
from ..operators.reviews import parse_reviews
from ..plans.ordered_text import PART_BYTES
from ..plans.routing import route_reviews
from ..sinks.files import write_reports
from ..sources.tree import decode_text, read_files, source_file_filter
from ..storage import materialize
from .tree_stream import read_tree_stream

SNAPSHOT_EVERY = 50


def stream_source_chunks(spark: SparkSession, root: str, max_bytes: int = MAX_CHUNK_BYTES,
                         partitions: int | None = None, **options: str) -> DataFrame:
    """A streaming table of chunks of the source files that appear below ``root``."""
    names = source_file_filter(read_tree_stream(spark, root, **options))
    # Names are dealt out by path before any content is read.
    n = partitions or spark.sparkContext.defaultParallelism
    files = decode_text(read_files(names.repartition(n, "path")))
    return chunk_lines(files.select("path", "content"), max_bytes)


def _so_far(spark: SparkSession, deltas: str, snapshots: str, schema: str, batch_id: int,
            combine: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What the batches before this one left in ``deltas``, combined.

    Every so often the combined rows are written, so a batch reads the last such snapshot and the
    few batches since. The filter on the batch prunes folders.
    """
    since = max(batch_id - 1, 0) // SNAPSHOT_EVERY * SNAPSHOT_EVERY
    try:
        rows = spark.read.schema(f"{schema}, batch bigint").parquet(deltas)
        rows = rows.filter((F.col("batch") >= since) & (F.col("batch") < batch_id)).drop("batch")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        # Known to be empty before it runs, so that joins with it fall away.
        rows = spark.createDataFrame([], schema).filter(F.lit(False))
    if since:
        rows = rows.unionByName(spark.read.schema(schema).parquet(f"{snapshots}/at={since}"))
    rows = combine(rows)
    if batch_id and batch_id % SNAPSHOT_EVERY == 0:
        rows.write.mode("overwrite").parquet(f"{snapshots}/at={batch_id}")
        rows = spark.read.schema(schema).parquet(f"{snapshots}/at={batch_id}")
    return rows


def stream_reviews_to_reports(archived: DataFrame, root: str, state: str, order: list[str],
                              part_bytes: int = PART_BYTES) -> DataStreamWriter:
    """Render archived reviews as they arrive and add them to the reports below ``root``.

    ``archived`` is a stream with ``modified_label``. The ledger keeps how many bytes each batch gave
    each report, so every batch knows where its sections start and a repeated batch rewrites them in
    place. Sections of one batch stand in ``order``. Every so often the ledger is summed up.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        base = _so_far(
            batch.sparkSession, f"{state}/ledger", f"{state}/snapshot", "report_path string, bytes bigint", batch_id,
            lambda rows: rows.groupBy("report_path").agg(F.sum("bytes").alias("bytes")),
        )
        parts = assemble_reports(render_markdown(batch), order, part_bytes)
        known = parts.select("report_path").distinct().join(base, "report_path")
        if batch_id:
            # Used three times below. Before the first batch nothing is known, and nothing is to be read for it.
            known = materialize(known, "known-reports")
        # Sections behind earlier ones start with the separator.
        parts = parts.join(known.select("report_path", F.lit(True).alias("_more")), "report_path", "left").withColumn(
            "markdown",
            F.when(F.col("_more") & (F.col("part_no") == 0), F.concat(F.lit(tx.SECTION_SEPARATOR), "markdown"))
            .otherwise(F.col("markdown")),
        ).drop("_more")
        written = write_reports(parts, root, known)
        gained = written.join(known.withColumnRenamed("bytes", "_had"), "report_path", "left").select(
            "report_path", (F.col("bytes") - F.coalesce("_had", F.lit(0))).alias("bytes")
        )
        gained.write.mode("overwrite").parquet(f"{state}/ledger/batch={batch_id}")

    return archived.writeStream.foreachBatch(write)


def stream_review_state(reviews: DataFrame, index: DataFrame, out: str, order: str = "seq") -> DataStreamWriter:
    """Route reviews as they arrive: each takes its next function from what its project has left.

    ``reviews`` is a stream of ``project``, ``order`` (unique per project) and ``review_message``;
    ``index`` is the static table of keys. Signals go to ``out/signals``, one folder per batch; the
    keys they took are the state, so nothing per project is held in one task. Reviews of one batch are
    served in ``order``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        taken = _so_far(
            batch.sparkSession, f"{out}/signals", f"{out}/snapshot", "project string, key string", batch_id,
            lambda rows: rows.filter(F.col("key").isNotNull()),
        )
        routed = route_reviews(parse_reviews(batch), index, taken, order)
        routed.write.mode("overwrite").parquet(f"{out}/signals/batch={batch_id}")

    return reviews.writeStream.foreachBatch(write)
