"""Column expressions: each is a built-in Spark expression, none runs Python per row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Extensions that count as source code (matched with case, without the dot).
SOURCE_EXTENSIONS = (
    "py", "cpp", "hpp", "cc", "cxx", "rs", "c", "js", "jsx", "ts", "tsx", "java", "go",
    "sh", "php", "rb", "kt", "kts", "swift", "pl", "pm", "r", "pas", "f90", "lisp", "cbl", "zig",
)

# The characters of the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Review-message delimiter, report defaults and severity labels.
PART_DELIMITER = "``"
MIN_PARTS = 6
DEFAULT_SEVERITY = "Unknown"
DEFAULT_REVIEW = "No review provided"
SEVERITY_SPANS = {
    "1": '<span style="color:green;">Low Severity</span>',
    "2": '<span style="color:orange;">Medium Severity</span>',
    "3": '<span style="color:red;">High Severity</span>',
}
SEVERITY_UNKNOWN = '<span style="color:gray;">Unknown Severity</span>'

REPORT_ROOT = "review_output"


def trim_space(c: Column) -> Column:
    """Trim Unicode white space; plain ``trim`` removes the space character only."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def extension(path: Column) -> Column:
    """The last extension of the file name; empty when it has none, as for ``.py``."""
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def text_lines(content: Column) -> Column:
    """Lines without terminators (LF or CRLF); a final terminator adds no empty line."""
    body = (
        F.when(content.endswith("\r\n"), F.left(content, F.length(content) - 2))
        .when(content.endswith("\n"), F.left(content, F.length(content) - 1))
        .otherwise(content)
    )
    return F.when(content == "", F.array().cast("array<string>")).otherwise(F.split(body, "\r?\n", -1))


def numbered_line(line_no: Column, line: Column) -> Column:
    """``%6d: text`` plus newline; the width is a minimum, longer numbers stay whole."""
    return F.format_string("%6d: %s\n", line_no, line)


def base_name(name: Column) -> Column:
    """The part after the last colon."""
    return F.substring_index(name, ":", -1)


def index_key(path: Column, name: Column) -> Column:
    return F.concat(path, F.lit(":"), name)


def key_suffixes(key: Column) -> Column:
    """What follows each colon of a key, the longest first."""
    parts = F.split(key, ":", -1)
    return F.transform(
        F.sequence(F.lit(2), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ":"),
    )


def severity_label(severity: Column) -> Column:
    label = F.lit(SEVERITY_UNKNOWN)
    for level, span in SEVERITY_SPANS.items():
        label = F.when(severity == level, F.lit(span)).otherwise(label)
    return label


def display_name(name: Column) -> Column:
    """The second colon-separated part, or the whole name when it has no colon."""
    return F.when(name.contains(":"), F.get(F.split(name, ":", -1), F.lit(1))).otherwise(name)


def review_parts(message: Column) -> Column:
    """Split a review message: strip ``{``, then ``}``, then white space; trim every part."""
    body = trim_space(F.btrim(F.btrim(message, F.lit("{")), F.lit("}")))
    return F.transform(F.split(body, PART_DELIMITER, -1), trim_space)


def report_path(path: Column) -> Column:
    """Where the report of a source file goes: normal path parts only, extension ``.md``."""
    parts = F.filter(F.split(path, "/", -1), lambda p: ~p.isin("", ".", ".."))
    relative = F.array_join(parts, "/")
    stem = F.regexp_replace(relative, r"(?<=[^/])\.[^./]*$", "")
    return F.concat(F.lit(f"{REPORT_ROOT}/"), stem, F.lit(".md"))


def markdown_section(name: Column, severity: Column, review: Column, path: Column,
                     start_line: Column, end_line: Column, modified: Column) -> Column:
    # The layout of one report section.
    return F.format_string(
        "## Function: `%s`\n\n"
        "| **Aspect**        | **Details** |\n"
        "|-------------------|------------|\n"
        "| **Severity**      | %s |\n"
        "| **Description**   | %s |\n"
        "| **File Location** | %s (Lines %d-%d) |\n"
        "| **Last Modified** | %s |\n",
        display_name(name), severity_label(severity), review, path, start_line, end_line, modified,
    )


# Fixed value: what stands between two sections of one report.
SECTION_SEPARATOR = "\n---\n\n"


def modified_label(modified: Column, path: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` in the session time zone, or an error text for an unknown file."""
    # The time format and how the error text begins.
    return F.coalesce(
        F.date_format(modified, "yyyy-MM-dd HH:mm:ss"),
        F.concat(F.lit("Error: Failed to get metadata: "), path),
    )
