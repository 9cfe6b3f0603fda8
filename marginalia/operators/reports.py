"""Markdown reports: one section per review, one report per source file."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..plans.ordered_text import PART_BYTES, ordered_text
from .reviews import parse_reviews


def modified_time_label(df: DataFrame, modified: str = "modified", path: str = "path") -> DataFrame:
    """Add ``modified_label``, the modified time as text; a NULL time gives an error text."""
    return df.withColumn("modified_label", tx.modified_label(F.col(modified), F.col(path)))


def with_modified_time(reviews: DataFrame, files: DataFrame) -> DataFrame:
    """Add the label of each review's file from a scan; files the scan did not see get the error text."""
    seen = files.select("project", "path", "modified")
    return modified_time_label(reviews.join(seen, ["project", "path"], "left")).drop("modified")


def render_markdown(archived: DataFrame) -> DataFrame:
    """Add the ``section`` of each archived review. ``modified_label`` must be there."""
    section = tx.markdown_section(
        F.col("name"), F.col("severity"), F.col("review"), F.col("path"),
        F.col("start_line"), F.col("end_line"), F.col("modified_label"),
    )
    return parse_reviews(archived).withColumn("section", section).select(*archived.columns, "section")


def with_report_path(df: DataFrame) -> DataFrame:
    return df.withColumn("report_path", tx.report_path(F.col("path")))


def assemble_reports(sections: DataFrame, order: list[str], part_bytes: int = PART_BYTES) -> DataFrame:
    """Sections joined per report in ``order``, as parts of bounded size: ``report_path, part_no, markdown``.

    Files that differ in their extension only share a report.
    """
    rows = with_report_path(sections).select("report_path", *order, "section")
    return ordered_text(rows, ["report_path"], order, "section", tx.SECTION_SEPARATOR, part_bytes).withColumnRenamed(
        "text", "markdown"
    )
