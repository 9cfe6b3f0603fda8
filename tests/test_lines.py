import random

import brute
from pyspark.sql import functions as F

from marginalia.operators import lines
from marginalia.sources import tree

SCHEMA = "project string, path string, content string"


def test_line_ends_and_empty_files(spark):
    texts = {"crlf": "a\r\nb\r\n", "open": "a\nb", "bare": "a\rb\r", "double": "x\r\r\ny", "empty": "", "blank": "\n", "two": "\n\n"}
    df = spark.createDataFrame([("p", k, v) for k, v in texts.items()], SCHEMA)
    got = {}
    for r in lines.split_lines(df).orderBy("path", "line_no").collect():
        got.setdefault(r["path"], []).append((r["line_no"], r["line"]))
    assert got == {
        "crlf": [(1, "a"), (2, "b")], "open": [(1, "a"), (2, "b")], "bare": [(1, "a\rb\r")],
        "double": [(1, "x\r"), (2, "y")], "blank": [(1, "")], "two": [(1, ""), (2, "")],
    }


def test_number_width_is_a_minimum(spark):
    df = spark.createDataFrame([(7, "a"), (1_234_567, "b")], "line_no bigint, line string")
    assert [r["numbered"] for r in lines.number_lines(df).orderBy("line_no").collect()] == ["     7: a\n", "1234567: b\n"]


def test_chunks_match_one_by_one_packing(spark):
    rng = random.Random(5)
    words = ["a", "é", "日本", "x" * 40, ""]
    texts = ["\n".join("".join(rng.choices(words, k=rng.randint(0, 4))) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    texts += ["y" * 300 + "\nshort\n", "short\n" + "y" * 300 + "\nshort", ""]
    df = spark.createDataFrame([("p", f"f{i}", t) for i, t in enumerate(texts)], SCHEMA)
    got = {}
    for r in lines.chunk_lines(df, 120).orderBy("path", "chunk_no").collect():
        got.setdefault(r["path"], []).append((r["first_line"], r["last_line"], r["content"]))
    assert got == {f"f{i}": brute.chunks(t, 120) for i, t in enumerate(texts) if t}


def test_last_chunk_is_marked_once_per_project(spark):
    df = spark.createDataFrame(
        [("p", "a", "1\n2\n3"), ("p", "b", "1\n2\n3\n4"), ("p", "c", ""), ("q", "z", "1")], SCHEMA
    )
    marked = lines.mark_last_chunk(lines.chunk_lines(df, 20)).filter("is_last").select("project", "path", "chunk_no")
    assert sorted(map(tuple, marked.collect())) == [("p", "b", 1), ("q", "z", 0)]


def test_fold_runs_once_and_without_shuffle(spark):
    df = spark.createDataFrame([("p", "a", "1\n2")], SCHEMA)
    plan = lines.chunk_lines(df, 20)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("aggregate(") == 1


def test_decoding_leaves_out_bad_files(spark):
    df = spark.createDataFrame([("a", bytearray(b"\xff\xfe")), ("b", bytearray("é".encode())), ("c", None)], "path string, content binary")
    assert [tuple(r) for r in tree.decode_text(df).collect()] == [("b", "é")]
    assert sorted(r["path"] for r in tree.decode_rejects(df).select(F.col("path")).collect()) == ["a", "c"]
