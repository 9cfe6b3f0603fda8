"""The whole review: source trees in, one Markdown report per source file out."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..operators import lines, prompts, records, reports, walk
from ..operators.detect import detect_functions, uncovered_files
from ..operators.model import SETTINGS, ModelFn, complete_prompts
from ..session import tune
from ..sinks.files import append_records, append_review_log, dump_index, write_reports
from ..sinks.record_store import read_records, stored_runs
from ..sources import tree
from ..storage import materialize, posix_path
from .ordered_text import whole_texts


@dataclass
class Review:
    """The tables a review leaves behind."""

    files: DataFrame      # project, path, modified, length
    records: DataFrame    # project, path, name, start_line, end_line, record_no
    reviews: DataFrame    # project, step, path, name, start_line, end_line, review_message, error, status
    reports: DataFrame    # report_path, bytes
    skipped: DataFrame    # project, path, reason


def list_projects(spark: SparkSession, roots: dict[str, str],
                  extensions: tuple[str, ...] = tx.SOURCE_EXTENSIONS) -> DataFrame:
    """The source files of several projects, without their contents."""
    return materialize(tree.source_file_filter(tree.list_trees(spark, roots), extensions), "files")


def skipped_files(files: DataFrame, detected: bool) -> DataFrame:
    """``project, path, reason`` of the listed files that give no records; read when the table is asked for."""
    contents = tree.read_files(files.repartition(tree.partitions_for(files), "path"))
    rejects = tree.decode_rejects(contents).select("project", "path", F.lit("not readable as UTF-8").alias("reason"))
    if not detected:
        return rejects
    return rejects.unionByName(uncovered_files(files).select("project", "path", F.lit("no detector for its language").alias("reason")))


def read_projects(files: DataFrame, most: int | None = None) -> DataFrame:
    """The text of listed files, read by tasks that got their share of the paths; ``most`` files at most."""
    n = tree.partitions_for(files)
    n = n if most is None else max(1, min(n, most))
    return tree.decode_text(tree.read_files(files.repartition(n, "path"))).select("project", "path", "content")


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Give each record a number that grows in ``order`` within its project.

    The numbers are unique and ordered, not dense: rows are range-partitioned by project and order,
    and a row's number is its partition and its place in it.
    """
    ranges = rows.sparkSession.sparkContext.defaultParallelism * 2
    sorted_rows = rows.repartitionByRange(ranges, "project", *order).sortWithinPartitions("project", *order)
    return materialize(sorted_rows.withColumn("record_no", F.monotonically_increasing_id()), "numbered")


def extract_records(files: DataFrame, model_fn: ModelFn | None, max_bytes: int = lines.MAX_CHUNK_BYTES,
                    concurrency: int | None = None, **asking) -> DataFrame:
    """Function records of all files, numbered in file order. Without a model they are detected."""
    if model_fn is None:
        found = detect_functions(files).filter(F.col("status") == "found").withColumnRenamed("record_no", "line_no")
        record = F.format_string('{"%s", "%s", %d, %d}', "name", "path", "start_line", "end_line")
        return _numbered(found.withColumn("record", record).drop("status"), ["path", "line_no"])
    asked = prompts.extract_prompt(lines.chunk_lines(files.select("project", "path", "content"), max_bytes))
    answered = complete_prompts(asked.select("project", "path", "chunk_no", "prompt", *SETTINGS), model_fn, concurrency=concurrency, **asking)
    texts = records.clean_completion(records.completion_content(answered)).filter(F.col("cleaned").isNotNull())
    lines_of = records.explode_records(texts.select("project", "path", "chunk_no", "cleaned")).withColumnsRenamed(
        {"path": "file_path", "record_no": "line_no"}
    )
    parsed = records.parse_records(lines_of.withColumn("text", F.col("record")), "text")
    return _numbered(parsed, ["file_path", "chunk_no", "line_no"])


def choose_seeds(found: DataFrame, model_fn: ModelFn, concurrency: int | None = None, **asking) -> DataFrame:
    """Ask the model once per project which function comes first; without an answer there is no seed."""
    asked = whole_texts(prompts.seed_prompt(found, ["record_no"]), ["project"], carried=SETTINGS).withColumnRenamed("text", "prompt")
    answered = records.completion_content(complete_prompts(asked, model_fn, concurrency=concurrency, **asking))
    one = answered.filter(F.col("content").isNotNull()).withColumn("record_no", F.lit(0))
    return records.seed_function(one).select("project", "path", "name")


def review_tree(spark: SparkSession, roots: dict[str, str], out: str, review_fn: ModelFn,
                extract_fn: ModelFn | None = None, seed_fn: ModelFn | None = None, max_steps: int | None = None,
                concurrency: int | None = None, run_id: str | None = None, **asking) -> Review:
    """Scan, extract, choose the first functions, walk, and write the reports below ``out``.

    ``extract_fn`` lists functions (else they are detected), ``seed_fn`` chooses where each project
    starts (else its first record), ``review_fn`` reviews. Next to the reports ``out`` gets the
    function records of this run, the index and the log of all review messages. A ``run_id`` whose records are
    stored there already is taken up again: its functions are not listed anew, in the order they had. ``asking`` goes to ``complete_prompts``: with a
    ``ledger`` the answers of a run that ended half way are not paid for again.
    """
    files = list_projects(tune(spark), roots)
    kept = "file://" + posix_path(out)
    store = f"{kept}/function_records"
    if run_id is not None and not stored_runs(spark, store).filter(F.col("run") == run_id).isEmpty():
        stored = read_records(spark, store, run_id).drop("run").withColumn("text", F.col("record"))
        found = materialize(records.parse_records(stored, "text"), "resumed")
    else:
        found = extract_records(read_projects(files), extract_fn, concurrency=concurrency, **asking)
        append_records(found, store, run_id or uuid.uuid4().hex)
    seeds = choose_seeds(found, seed_fn, concurrency, **asking) if seed_fn else None
    # A step reads the files of the functions due; a path that no listing has is not opened.
    due_files = lambda due: read_projects(
        files.join(due.select("project", "path").distinct(), ["project", "path"]), due.count()
    )
    walked = walk.model_walk(found, due_files, review_fn, seeds, max_steps, concurrency=concurrency, **asking)
    reviewed = reports.with_modified_time(walked.filter(F.col("error").isNull()), files)
    sections = reports.render_markdown(reviewed)
    written = write_reports(reports.assemble_reports(sections, ["project", "step"]), out)
    dump_index(records.function_index(found), f"{kept}/function_index")
    append_review_log(walked.filter(F.col("review_message").isNotNull()), f"{kept}/review_log")
    return Review(files, found, walked, written, skipped_files(files, extract_fn is None))
