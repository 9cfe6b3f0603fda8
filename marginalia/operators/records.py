"""From model completions to function records and their index."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx

# Fixed value: one function record, {"name", "path", start, end}. White space is any Unicode space.
_S = r"[\s\x0B\x85\p{Z}]*"
RECORD_PATTERN = r'\{' + _S + r'"([^"]+)",' + _S + r'"([^"]+)",' + _S + r"(\d+)," + _S + r"(\d+)" + _S + r"\}"

# The Markdown fence a model may put around its answer.
FENCE_OPEN, FENCE_CLOSE = "```json\n", "```"


def completion_content(df: DataFrame, response: str = "response", out: str = "content") -> DataFrame:
    """``choices[0].message.content`` of a response document; NULL when it is not there."""
    return df.withColumn(out, F.get_json_object(response, "$.choices[0].message.content"))


def _unwrap(c, opening: str, closing: str):
    """Remove the pair only when both ends are present and do not overlap."""
    inner = F.substring(c, F.lit(len(opening) + 1), F.length(c) - len(opening) - len(closing))
    both = c.startswith(opening) & c.endswith(closing) & (F.length(c) >= len(opening) + len(closing))
    return F.when(both, inner).otherwise(c)


def clean_completion(df: DataFrame, content: str = "content", out: str = "cleaned") -> DataFrame:
    """Drop a JSON fence, trim, drop one pair of brackets, trim."""
    return df.withColumn(out, tx.trim_space(_unwrap(F.col(content), FENCE_OPEN, FENCE_CLOSE))).withColumn(
        out, tx.trim_space(_unwrap(F.col(out), "[", "]"))
    )


def explode_records(df: DataFrame, content: str = "cleaned") -> DataFrame:
    """One row per line that is not empty once trailing commas are gone; ``record_no`` counts from 0.

    ``record_no`` is the line's position in its completion, so it orders records but may skip numbers.
    """
    keep = [c for c in df.columns if c != content]
    lines = F.transform(tx.text_lines(F.col(content)), lambda x: F.rtrim(tx.trim_space(x), F.lit(",")))
    return (
        df.select(*keep, F.posexplode_outer(lines).alias("record_no", "record"))
        .filter(F.col("record") != "")
        .withColumn("record_no", F.col("record_no").cast("bigint"))
    )


def parse_records(df: DataFrame, record: str = "record") -> DataFrame:
    """Name, path and line range of the first record in each text; other texts are dropped.

    The record's own path replaces the ``path`` column, as it is the record that is indexed.
    """
    groups = [F.regexp_extract(record, RECORD_PATTERN, i) for i in range(1, 5)]
    keep = [c for c in df.columns if c not in (record, "path", "name", "start_line", "end_line")]
    return df.filter(F.col(record).rlike(RECORD_PATTERN)).select(
        *keep,
        groups[0].alias("name"),
        groups[1].alias("path"),
        groups[2].try_cast("bigint").alias("start_line"),
        groups[3].try_cast("bigint").alias("end_line"),
    )


def seed_function(df: DataFrame, content: str = "content", order: tuple[str, ...] = ("record_no",)) -> DataFrame:
    """The first record found anywhere in a project's seed response.

    A response kept in several rows is read in ``order``. One map-side combined aggregate.
    """
    first = F.min(F.struct(*order, "name", "path", "start_line", "end_line")).alias("s")
    found = parse_records(df.select("project", *order, F.col(content).alias("_text")), "_text")
    return found.groupBy("project").agg(first).select(
        "project", "s.name", "s.path", "s.start_line", "s.end_line"
    )


def function_index(records: DataFrame) -> DataFrame:
    """Distinct ``path:name`` keys of each project with the path.

    With ``record_no`` the last record of a key gives the path, which matters only for paths with a
    colon in them. The path is a prefix of the key, so only its length is aggregated: fixed-width
    buffers keep this a hash aggregate that combines a hot key before the shuffle.
    """
    keyed = records.select(
        "project", tx.index_key(F.col("path"), F.col("name")).alias("key"), F.length("path").alias("_len"),
        *(["record_no"] if "record_no" in records.columns else []),
    )
    if "record_no" in records.columns:
        pick = F.max_by("_len", F.col("record_no"))
    else:
        pick = F.max("_len")
    return keyed.groupBy("project", "key").agg(pick.alias("_len")).select(
        "project", "key", F.left("key", F.col("_len")).alias("path")
    )


def index_lines(index: DataFrame) -> DataFrame:
    """The text lines of an index dump."""
    # Fixed value: the layout of one line.
    return index.select(F.concat(F.lit("Key: "), "key", F.lit(" | Value: "), "path").alias("value"))


def with_base_name(df: DataFrame, name: str = "name", out: str = "base_name") -> DataFrame:
    return df.withColumn(out, tx.base_name(F.col(name)))
