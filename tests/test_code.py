import random

import pytest

from marginalia.operators import code

RECORD = "project string, path string, name string, start_line bigint, end_line bigint"


@pytest.mark.parametrize("block_lines", [1, 3, 7, 10_000])
def test_content_matches_slicing(spark, block_lines):
    rng = random.Random(block_lines)
    files = {f"f{i}": [f"{i}-{n}" for n in range(rng.randint(1, 40))] for i in range(12)}
    ranges = [(f"f{rng.randint(0, 12)}", rng.randint(0, 42), rng.randint(0, 45)) for _ in range(300)]
    ranges += [("f0", 1, 10**15), ("f0", -5, 2), ("f0", 1, 1), ("f0", 1, 1)]
    df = spark.createDataFrame([("p", p, f"n{i}", a, b) for i, (p, a, b) in enumerate(ranges)], RECORD)
    source = spark.createDataFrame([("p", p, "\n".join(x)) for p, x in files.items()], "project string, path string, content string")
    got = {r["name"]: (r["content"], r["status"]) for r in code.function_content(df, source, block_lines).collect()}
    assert len(got) == len(ranges)
    for i, (path, a, b) in enumerate(ranges):
        lines = files.get(path, [])
        good = 1 <= a <= b <= len(lines)
        assert got[f"n{i}"] == (("\n".join(lines[a - 1:b]), "ok") if good else (None, "bad_range")), (path, a, b)


def exchanges(plan):
    """The shuffles of a finished plan: the columns of each and the rows it wrote."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return exchanges(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return exchanges(plan.plan())
    below = plan.children()
    found = [x for i in range(below.size()) for x in exchanges(below.apply(i))]
    if kind == "ShuffleExchangeExec":
        output = plan.output()
        rows = plan.metrics().apply("shuffleRecordsWritten").value()
        found.append(({output.apply(i).name() for i in range(output.size())}, rows))
    return found


def test_contents_of_files_without_records_meet_no_exchange(spark, shared):
    folder = shared("many-files")
    spark.range(2000, numPartitions=4).selectExpr("'p' as project", "concat('f', id) as path", "repeat('line\n', 20) as content").write.parquet(folder)
    records = spark.createDataFrame([("p", f"f{i * 100}", f"n{i}", 1, 1 + i) for i in range(10)] + [("p", None, "none", 1, 2), (None, "f1", "none", 1, 1)], RECORD)
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for name in names:
        spark.conf.set(name, "-1")
    try:
        df = code.function_content(records, spark.read.parquet(folder))
        rows = df.collect()
        found = exchanges(df._jdf.queryExecution().executedPlan())
    finally:
        for name in names:
            spark.conf.unset(name)
    assert sorted((r["name"], r["content"]) for r in rows if r["content"]) == [(f"n{i}", "\n".join(["line"] * (1 + i))) for i in range(10)]
    assert len(rows) == 12 and len(found) >= 2
    with_content = [n for columns, n in found if "content" in columns]
    # The files that have records, and at most a chance one.
    assert with_content and sum(with_content) <= 12


def test_exact_name_goes_before_base_name(spark):
    rows = [("p", "x", "A:foo", 1, 2, 1), ("p", "x", "B:foo", 3, 4, 2), ("p", "x", "foo", 5, 6, 3), ("p", "y", "bar", 7, 8, 4)]
    records = spark.createDataFrame(rows, RECORD + ", record_no bigint")
    asked = spark.createDataFrame(
        [("p", "B:foo", "x"), ("p", "C:foo", "x"), ("p", "foo", "x"), ("p", "bar", "x"), ("p", "Z:bar", "y")],
        "project string, next_key string, next_path string",
    )
    got = {r["next_key"]: r["found_record_no"] for r in code.find_function(asked, records).collect()}
    assert got == {"B:foo": 2, "C:foo": 1, "foo": 3, "bar": None, "Z:bar": 4}
