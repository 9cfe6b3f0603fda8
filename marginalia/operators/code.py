"""Looking functions up and cutting their lines out of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..storage import materialize

# Lines cut from a file in one row, unless a single range has more.
CUT_LINES = 65_536
# Bits of the filter on files, in rows of 32,768 bits: two megabytes, whatever the number of records.
FILTER_BITS = 1 << 24


def files_with_records(files: DataFrame, records: DataFrame) -> DataFrame:
    """The files that may have records: few others pass, and none that has records is left out.

    The keys of the records set bits of a table of fixed size, which goes to where the files are read. So the
    contents of files without records meet no exchange.
    """
    # Spark numbers the bits of its bitmaps from 1.
    at = F.pmod(F.xxhash64("project", "path"), F.lit(FILTER_BITS)) + 1
    bucket, place = F.bitmap_bucket_number(at), F.bitmap_bit_position(at)
    bits = records.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(place).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.expr("_byte >> cast(_place % 8 as int) & 1") == 1
    marked = files.withColumns({"_bucket": bucket, "_place": place}).join(F.broadcast(bits), "_bucket")
    return marked.withColumn("_byte", byte).filter(set_).select(*files.columns)


def function_content(records: DataFrame, files: DataFrame, block_lines: int = CUT_LINES) -> DataFrame:
    """Lines ``start_line..end_line`` of each record joined by newlines, with a ``status``.

    ``status`` is ``ok``, or ``bad_range`` with NULL content when the range is not inside the file
    (start below 1, start after end, end after the last line, or no such file).

    The records of a file are gathered into one row, in parts where they ask for more than ``block_lines`` lines, and
    that row is joined to the file once: a file is split into lines once and all ranges are cut from it. Only
    contents of files that have records are shuffled, and the cut lines not at all.
    """
    columns = records.columns
    sane = (F.col("start_line") >= 1) & (F.col("start_line") <= F.col("end_line"))
    lines = F.when(sane, F.least(F.col("end_line") - F.col("start_line") + 1, F.lit(block_lines))).otherwise(0)
    weight = records.groupBy("project", "path").agg(F.sum(F.greatest(lines, F.lit(1))).alias("_lines")).filter(F.col("_lines") > block_lines)
    wide = materialize(weight.select("project", "path", F.ceil(F.col("_lines") / block_lines).alias("_parts")), "wide-files")
    part = F.lit(0).cast("bigint")
    if not wide.isEmpty():
        records = records.join(wide, ["project", "path"], "left")
        part = F.pmod(F.xxhash64(*columns), F.coalesce("_parts", F.lit(1)))
    gathered = records.groupBy("project", "path", part.alias("_part")).agg(F.collect_list(F.struct(*columns)).alias("_records"))
    held = files_with_records(files.select("project", "path", "content"), gathered)

    def cut(lines, record):
        start, end = record["start_line"], record["end_line"]
        inside = (start >= 1) & (start <= end) & (end <= F.size(lines))
        text = F.array_join(F.slice(lines, start.cast("int"), (end - start + 1).cast("int")), "\n")
        return F.struct(record.alias("record"), F.when(inside, text).alias("content"))

    # The lines are bound once, as the one element of an array: a column would be split again for every range.
    whole = F.transform(F.array(tx.text_lines(F.col("content"))), lambda lines: F.transform("_records", lambda r: cut(lines, r)))
    found = gathered.join(held, ["project", "path"], "left").select(F.explode(F.element_at(whole, 1)).alias("_cut"))
    status = F.when(F.col("content").isNull(), "bad_range").otherwise("ok")
    return found.select(*[F.col("_cut.record")[c].alias(c) for c in columns], F.col("_cut.content").alias("content")).withColumn("status", status)


def code_functions(records: DataFrame, files: DataFrame, block_lines: int = CUT_LINES) -> DataFrame:
    """Records whose lines exist, with their content; the remaining map stays the index table."""
    found = function_content(records, files, block_lines).filter(F.col("status") == "ok")
    return found.select("project", "path", "name", "start_line", "end_line", "content")


def name_lookups(records: DataFrame, order: tuple[str, ...] = ("record_no",)) -> tuple[DataFrame, DataFrame]:
    """The first record of every name, and of every base name, of each path."""
    record = F.struct(*order, "name", "start_line", "end_line") if "start_line" in records.columns else F.struct(*order, "name")
    by_name = records.groupBy("project", "path", "name").agg(F.min(record).alias("_exact"))
    by_base = (
        records.withColumn("_base", tx.base_name(F.col("name"))).groupBy("project", "path", "_base")
        .agg(F.min(record).alias("_near"))
    )
    return (
        by_name.withColumnsRenamed({"path": "next_path", "name": "next_key"}),
        by_base.withColumnRenamed("path", "next_path"),
    )


def find_in(signals: DataFrame, by_name: DataFrame, by_base: DataFrame) -> DataFrame:
    """Look signals up in the tables of ``name_lookups``; each has one row per lookup key."""
    found = (
        signals.withColumn("_base", tx.base_name(F.col("next_key")))
        .join(by_name, ["project", "next_path", "next_key"], "left")
        .join(by_base, ["project", "next_path", "_base"], "left")
    )
    hit = F.coalesce("_exact", "_near")
    fields = by_name.schema["_exact"].dataType.fieldNames()
    return found.select(*signals.columns, *[hit[c].alias(f"found_{c}") for c in fields])


def find_function(signals: DataFrame, records: DataFrame, order: tuple[str, ...] = ("record_no",)) -> DataFrame:
    """The record each signal (``next_path``, ``next_key``) asks for, as ``found_*`` columns.

    A record of the path with exactly that name wins, else the first one with the same base name.
    Records are reduced to one per name and one per base name before the join, so many records or
    many signals with one name never meet as pairs. Signals without a match keep NULLs.
    """
    return find_in(signals, *name_lookups(records, order))
