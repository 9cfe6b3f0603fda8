import random

import pytest

from marginalia.plans.ordered_text import ordered_text, whole_texts


@pytest.mark.parametrize("part_bytes", [1, 50, 400, 1 << 20])
def test_parts_join_to_the_whole(spark, part_bytes):
    rng = random.Random(part_bytes)
    rows = []
    for group, n in [("hot", 700), ("a", 30), ("b", 1), ("c", 2)]:  # one group holds nearly all rows
        rows += [(group, i // 2, f"{group}{i}é" * rng.randint(0, 4)) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o bigint, t string")
    parts = ordered_text(df, ["g"], ["o"], "t", "\n-\n", part_bytes).collect()
    hot_parts = sum(r["g"] == "hot" for r in parts)
    assert hot_parts == 1 if part_bytes == 1 << 20 else hot_parts > 100
    for group in ("hot", "a", "b", "c"):
        mine = sorted((r["part_no"], r["text"]) for r in parts if r["g"] == group)
        texts = [t for _, t in sorted((o, t) for g, o, t in rows if g == group)]
        assert "".join(t for _, t in mine) == "\n-\n".join(texts)
        longest = max(len(t.encode()) for t in texts)
        assert all(len(t.encode()) <= part_bytes + longest + 6 for _, t in mine)


def test_whole_texts_are_whole_at_any_size(spark):
    rows = [("a", 1, "yy", 3), ("a", 0, "xx", 3), *[("b", i, "z" * (1 << 20), 4) for i in range(40)]]
    df = spark.createDataFrame(rows, "g string, part_no bigint, text string, n int")
    got = {r["g"]: (r["text"], r["n"]) for r in whole_texts(df, ["g"], carried=("n",)).collect()}
    assert got == {"a": ("xxyy", 3), "b": ("z" * (40 << 20), 4)}


def test_ranges_are_not_made_from_texts(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    seen, make = [], DataFrame.repartitionByRange
    monkeypatch.setattr(DataFrame, "repartitionByRange", lambda self, n, *cols: seen.append(cols) or make(self, n, *cols))
    df = spark.createDataFrame([("a", i, "t" * 50) for i in range(30)], "g string, o bigint, t string")
    ordered_text(df, ["g"], ["o"], "t", "", 100).collect()
    assert seen == [("g", "o")]
