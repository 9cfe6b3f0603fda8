"""Writing reports, logs, records and the index."""

from __future__ import annotations

import contextlib
import hashlib
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..operators.records import index_lines
from ..storage import materialize, posix_path
from .record_store import write_records


COPY_BYTES = 8 << 20
# What a task that writes or moves files gets of them, at most and, as far as there are cores, at least; and bytes of text, about.
MOST_FILES, LEAST_FILES, TASK_BYTES = 10_000, 500, 64 << 20


def _put(handle: int, data: bytes, at: int) -> None:
    rest = memoryview(data)
    while rest:
        done = os.pwrite(handle, rest, at)
        rest, at = rest[done:], at + done


def _make_folder(folder: str, made: set[str]) -> None:
    if folder not in made:
        os.makedirs(folder, exist_ok=True)
        made.add(folder)


def _tasks(spark: SparkSession, files: int, size: int = 0) -> int:
    """Among how many tasks files are dealt: by their number, as small files cost by the file."""
    some = min(spark.sparkContext.defaultParallelism, -(-files // LEAST_FILES))
    return max(1, some, -(-files // MOST_FILES), -(-size // TASK_BYTES))


def _staged(target: str, stage: str) -> str:
    """Where a file waits: beside its place, as moves within a folder do not wait for each other as those between folders do."""
    folder, name = os.path.split(target)
    return os.path.join(folder, f"{os.path.basename(stage)}-{hashlib.md5(os.fsencode(name)).hexdigest()}")


def _writer(root: str, stage: str):
    """Parts into files of the stage, each at its own offset; the first new part brings the bytes before it along."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folders: set[str] = set()
        for frame in frames:
            for path, body, offset, base in zip(frame["report_path"], frame["markdown"], frame["offset"], frame["base"]):
                target = os.path.join(root, path)
                _make_folder(os.path.dirname(target), folders)
                handle = os.open(_staged(target, stage), os.O_CREAT | os.O_WRONLY, 0o644)
                try:
                    if base and offset == base:
                        with open(target, "rb") as old:
                            for at in range(0, int(base), COPY_BYTES):
                                _put(handle, old.read(min(COPY_BYTES, int(base) - at)), at)
                    _put(handle, body.encode(), int(offset))
                finally:
                    os.close(handle)
            yield frame[["report_path", "part_no", "offset", "total"]]

    return write


def _publisher(root: str, stage: str):
    """Whole files of the stage to their places. A file that a task before a lost one has moved is there already."""

    def publish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, size in zip(frame["report_path"], frame["bytes"]):
                target = os.path.join(root, path)
                staged = _staged(target, stage)
                try:
                    if (there := os.path.getsize(staged)) != size:
                        raise RuntimeError(f"{staged}: {there} bytes instead of {size}")
                    os.replace(staged, target)
                except FileNotFoundError:
                    if not os.path.exists(target) or os.path.getsize(target) != size:
                        raise
            yield frame

    return publish


def _clearer(root: str, stage: str):
    """Remove what a job that failed has staged."""

    def clear(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["report_path"]:
                with contextlib.suppress(FileNotFoundError):
                    os.unlink(_staged(os.path.join(root, path), stage))
            yield frame

    return clear


def write_reports(parts: DataFrame, root: str, base: DataFrame | None = None) -> DataFrame:
    """Write assembled report parts below ``root``, one Markdown file per report.

    Every part is put at its own byte offset in a hidden file ``.staged-...`` beside the report's place, so the parts of one large report are
    written by many tasks, and a task that runs again writes the same bytes to the same place. When all parts are
    written each file is moved to its place in one step: a reader sees the old report or the new one, and a job that
    fails leaves the old ones. ``root`` must be a file system that all executors mount. ``base`` (``report_path,
    bytes``) holds what a report already has; its new parts go behind that. Returns the reports with their ``bytes``.
    """
    rows = materialize(
        parts.select("report_path", "part_no", "markdown", F.octet_length("markdown").cast("bigint").alias("_bytes")),
        "report-parts",
    )
    narrow = rows.select("report_path", "part_no", "_bytes")
    total = narrow.groupBy("report_path").agg(F.sum("_bytes").alias("_new"), F.count("*").alias("_parts"))
    if base is None:
        total = total.withColumn("_base", F.lit(0).cast("bigint"))
    else:
        known = base.select("report_path", F.col("bytes").alias("_base"))
        total = total.join(known, "report_path", "left").fillna(0, ["_base"])
    # Byte offsets need the lengths only; the texts are joined to them by their unique part number.
    before = W.partitionBy("report_path").orderBy("part_no").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        narrow.withColumn("_before", F.coalesce(F.sum("_bytes").over(before), F.lit(0)))
        .join(total, "report_path")
        .select(
            "report_path", "part_no", (F.col("_base") + F.col("_before")).alias("offset"), F.col("_base").alias("base"),
            (F.col("_base") + F.col("_new")).alias("total"),
        )
    )
    # The texts are dealt by the number of parts, not by bytes alone as adaptive execution would.
    n_parts, size = rows.agg(F.count("*"), F.coalesce(F.sum("_bytes"), F.lit(0))).first()
    dealt = rows.repartition(_tasks(rows.sparkSession, n_parts, size), "report_path", "part_no")
    placed = dealt.join(offsets, ["report_path", "part_no"]).select("report_path", "part_no", "markdown", "offset", "base", "total")
    root = posix_path(root)
    stage = os.path.join(root, f".staged-{uuid.uuid4().hex}")
    written = placed.mapInPandas(_writer(root, stage), "report_path string, part_no bigint, offset bigint, total bigint")
    try:
        sizes = materialize(written.groupBy("report_path").agg(F.max("total").alias("bytes")), "reports-staged")
        sizes = sizes.repartition(_tasks(sizes.sparkSession, sizes.count()), "report_path")
        return materialize(sizes.mapInPandas(_publisher(root, stage), "report_path string, bytes bigint"), "reports-written")
    except Exception:
        with contextlib.suppress(Exception):
            narrow.select("report_path").distinct().mapInPandas(_clearer(root, stage), "report_path string").count()
        raise


def append_review_log(df: DataFrame, path: str) -> None:
    """Append every raw review message, one per line, to the log."""
    df.select(F.col("review_message").alias("value")).write.mode("append").text(path)


def append_records(df: DataFrame, path: str, run_id: str, order: tuple[str, ...] = ("record_no",)) -> None:
    """Add cleaned record lines as one run of the record store, in their order; writing a run again replaces it."""
    write_records(df, path, run_id, order)


def dump_index(index: DataFrame, path: str) -> None:
    """Replace the dump of the index."""
    index_lines(index).write.mode("overwrite").text(path)
