"""Function records of many runs and projects as plain text, kept in their order.

A run is a folder of text files, one for each numbered part of a project, with nothing but record lines in them. Its
manifest says which project a part belongs to, the number of its first record and how many it has; it is written when
the parts are, so a run without one does not exist for readers.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..plans.ranks import with_place
from ..storage import materialize

# Records in a part; a part is one file, and is put in order by one task when it is read.
PART_ROWS = 65_536
_MANIFEST = "run string, project string, of string, part bigint, first bigint, rows bigint"


def write_records(df: DataFrame, path: str, run_id: str, order: tuple[str, ...] = ("record_no",)) -> None:
    """Write ``record`` lines as one run; writing a run again replaces it.

    Records of a ``project`` are numbered from 1 by ``order``, as far as those columns are there, and then by the text.
    A record of several lines is several records. Projects are named by a hash in the folder, as they may be any text.
    """
    names = [c for c in order if c in df.columns]
    project = F.col("project") if "project" in df.columns else F.lit(None).cast("string")
    of = F.coalesce(F.sha2(project.cast("binary"), 256), F.lit("none"))
    lines = df.select(project.alias("project"), of.alias("of"), *names, F.posexplode(F.split("record", "\n")).alias("_line", "record"))
    placed = with_place(lines, ["of"], [*names, "_line", "record"] if names else ["record"], "number", "record-lines")
    rows = materialize(placed.select("project", "of", F.expr(f"(number - 1) div {PART_ROWS}").alias("part"), "number", "record"), "records")
    parts = rows.groupBy("project", "of", "part").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("rows"))
    parts = materialize(parts, "parts")
    # Few small parts may share a task; a part is never divided.
    shards = max(1, min(parts.count(), 4 * df.sparkSession.sparkContext.defaultParallelism))
    dealt = rows.repartition(shards, "of", "part").sortWithinPartitions("of", "part", "number")
    dealt.select("of", "part", "record").write.partitionBy("of", "part").mode("overwrite").option("lineSep", "\n").text(f"{path}/run={run_id}")
    parts.coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifest/run={run_id}")


def stored_runs(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of all runs: ``run, project, of, part, first, rows``; empty if there is no store."""
    try:
        return spark.read.schema(_MANIFEST).parquet(f"{path}/_manifest").select("run", "project", "of", "part", "first", "rows")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def read_records(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """``run, project, record_no, record`` of one run or all, numbered as they were written.

    A part whose lines are not as many as its manifest says is an error when it is read.
    """
    runs = stored_runs(spark, path)
    runs = runs if run_id is None else runs.filter(F.col("run") == run_id)
    if runs.isEmpty():
        return spark.createDataFrame([], "run string, project string, record_no bigint, record string")
    lines = spark.read.schema("value string, run string, of string, part bigint").option("lineSep", "\n").text(path)
    lines = lines if run_id is None else lines.filter(F.col("run") == run_id)
    # A file may be read in blocks; within one, lines are met in their order.
    rows = lines.select("run", "of", "part", "value", F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    part = W.partitionBy("run", "of", "part")
    rows = rows.withColumn("_place", F.row_number().over(part.orderBy("_block", "_at"))).withColumn("_n", F.count(F.lit(1)).over(part))
    number = F.when(F.col("_n") == F.col("rows"), F.col("first") + F.col("_place") - 1).otherwise(
        F.raise_error(F.concat(F.lit("part "), "part", F.lit(" of run "), "run", F.lit(" is not as its manifest says"))).cast("bigint"))
    return rows.join(runs, ["run", "of", "part"]).select("run", "project", number.alias("record_no"), F.col("value").alias("record"))
