from pyspark.sql import functions as F

from marginalia.functions import text as tx
from marginalia.operators import reports, reviews


def test_message_of_the_documented_form(spark):
    texts = [
        "{load``1``Reads the settings``1``check``lib/check.go}",
        "{{ f `` 3 `` bad \u00a0`` 0 }}", "{f``2``x``1``g``p}\n", "plain", "", "{f```2``y}",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, review_message string")
    got = [tuple(r)[2:] for r in reviews.parse_reviews(df).orderBy("i").collect()]
    assert got == [
        ("1", "Reads the settings", "1", "check", "lib/check.go", 6),
        ("3", "bad", "0", None, None, 4),
        ("2", "x", "1", "g", "p}", 6),  # a brace before the line end stays
        ("Unknown", "No review provided", None, None, None, 1),
        ("Unknown", "No review provided", None, None, None, 1),
        ("`2", "y", None, None, None, 3),
    ]


def test_labels_and_names(spark):
    df = spark.createDataFrame([("1", "a"), ("2", "K:m"), ("3", "A::b"), ("1 ", "A:b:c"), ("Unknown", ":x")], "s string, n string")
    got = [tuple(r) for r in df.select(tx.severity_label(F.col("s")), tx.display_name(F.col("n"))).collect()]
    assert [g[1] for g in got] == ["a", "m", "", "b", "x"]
    assert ["Low" in got[0][0], "Medium" in got[1][0], "High" in got[2][0], "Unknown" in got[3][0], "Unknown" in got[4][0]] == [True] * 5


def test_remaining_map(spark):
    df = spark.sql("select map('a:f', 'a', 'b:g', 'b') as m, 'a:f' as k")
    assert df.select(reviews.remaining_map("m", "k").alias("m")).first()["m"] == {"b:g": "b"}


def test_suffix_lookup_is_an_equality_join(spark):
    parsed = reviews.parse_reviews(spark.createDataFrame([("p", "{f``1``x``1``g``no}")], "project string, review_message string"))
    index = spark.createDataFrame([("p", "z:g", "z"), ("p", "a:K:g", "a"), ("p", "a:xg", "a")], "project string, key string, path string")
    df = reviews.next_signal(parsed, index)
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
    row = df.first()
    assert (row["status"], row["key"], row["next_key"], row["next_path"]) == ("suffix", "a:K:g", "g", "a")


def test_report_paths(spark):
    paths = {
        "/repo/a.rs": "repo/a.md", "//x/./y/../f.tar.gz": "x/y/f.tar.md", "/x/.bashrc": "x/.bashrc.md", "Makefile": "Makefile.md",
        "d.x/Makefile": "d.x/Makefile.md", "f.": "f.md", "../../etc/passwd": "etc/passwd.md", "..foo": "..md",
    }
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r["path"]: r["report_path"] for r in reports.with_report_path(df).collect()}
    assert got == {p: f"review_output/{r}" for p, r in paths.items()}


def test_section_layout(spark):
    df = spark.sql("""select 'K:run' as name, '/s/a.rs' as path, 3L as start_line, 9L as end_line,
        '{run``2``Long | name``0}' as review_message, timestamp'2024-05-06 07:08:09' as modified""")
    section = reports.render_markdown(reports.modified_time_label(df)).first()["section"]
    assert section == (
        "## Function: `run`\n\n| **Aspect**        | **Details** |\n|-------------------|------------|\n"
        '| **Severity**      | <span style="color:orange;">Medium Severity</span> |\n'
        "| **Description**   | Long | name |\n| **File Location** | /s/a.rs (Lines 3-9) |\n"
        "| **Last Modified** | 2024-05-06 07:08:09 |\n"
    )
