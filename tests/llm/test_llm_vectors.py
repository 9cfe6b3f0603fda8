import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import catalog, hard_negatives as hn

SF = "/root/testdata/sf0.001"


def plain(rows, positives=5, negatives=5, low=80, high=100):
    """``(id, vector, label)`` rows, scored one by one in whole numbers."""
    taken = [(k, i, [int(np.floor(256.0 * x)) for x in v], label) for k, (i, v, label) in enumerate(rows)
             if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    first = lambda found: sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0, f[2]))
    for k, anchor, v, label in taken:
        if anchor is None or anchor % 100:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), i, j, m == label) for j, i, w, m in taken if j != k]
        for p in first([s for s in scored if s[3]])[:positives]:
            near = first([s for s in scored if not s[3] and low * p[0] <= 100 * s[0] <= high * p[0]])[:negatives]
            out += [(anchor, p[1], rank, n[1], p[0], n[0]) for rank, n in enumerate(near, 1)]
    return sorted(out, key=str)


def mined(spark, rows, **how):
    df = spark.createDataFrame([(*r, "clash", "clash", 1.0) for r in rows],
                               "vec_id long, embedding array<float>, label int, block string, key string, score double")
    out = hn.hard_negatives(df, F.col("vec_id") % 100 == 0, **how)
    return sorted([tuple(r)[:6] for r in out.collect()], key=str)


@pytest.mark.parametrize("most,dims", [(3, 4), (200, 64), (50_000, 1500), (1 << 20, 9)])
def test_products_are_exact(most, dims):
    rng = np.random.default_rng(dims)
    a, b = rng.integers(-most, most + 1, (40, dims)), rng.integers(-most, most + 1, (30, dims))
    assert (hn.exact_products(a, b) == np.array(a.astype(object) @ b.T.astype(object), dtype=object)).all()
    assert (hn.exact_products(a, a[:3]) == (a.astype(object) @ a[:3].T.astype(object))).all()


def test_products_of_no_rows_and_no_dimensions():
    assert hn.exact_products(np.zeros((0, 3), np.int64), np.zeros((2, 3), np.int64)).shape == (0, 2)
    assert (hn.exact_products(np.zeros((2, 0), np.int64), np.zeros((2, 0), np.int64)) == 0).all()


def vectors(seed, n, dims):
    rng = random.Random(seed)
    return [(i * 4, [round(rng.uniform(0, 1) if j else 1.0, 2) for j in range(dims)], rng.randrange(3)) for i in range(n)]


def test_mining_equals_one_by_one_scores(spark, monkeypatch):
    rows = vectors(1, 300, 6)
    # Ties: one vector under many ids, and whole rows again, an anchor among them.
    rows += [(1000 + i, rows[0][1], i % 3) for i in range(20)] + [rows[25], rows[25], rows[3]]
    expected = plain(rows)
    assert len(expected) > 200
    assert mined(spark, rows) == expected
    # Many small blocks, few anchors at a time, partial results given early: the same rows.
    for name, value in {"ROW_VALUES": 60, "ANCHOR_VALUES": 12, "BLOCKS_A_SALT": 4, "COLUMNS": 1, "HELD": 1}.items():
        monkeypatch.setattr(hn, name, value)
    assert mined(spark, rows) == expected
    assert mined(spark, rows, positives=2, negatives=3, low=50, high=90) == plain(rows, 2, 3, 50, 90)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(2, 60, 5)
    rows += [(None, rows[0][1], 0), (None, rows[1][1], 1), (200, None, 1), (300, [nan, 1.0], 1), (400, [inf, 1.0], 1), (500, [None, 1.0], 0),
             (600, [1.0, 2.0], None), (700, [1.0, 2.0], 1), (800, [], 2), (801, [], 2), (900, [-1.0] * 9, 0), (901, [-0.9] * 9, 0), (902, [-0.99] * 9, 1)]
    assert mined(spark, rows) == plain(rows)
    # A length whose scores could not be exact: the row takes no part.
    assert mined(spark, [*rows, (1000, [1e30, 1.0], 1), (1001, [3e38] * 5, 2)]) == plain(rows)
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, [(100, [1.0], 1), (2, [1.0], 2)]) == []


def test_op13_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    df = catalog.QUERIES["op13_hard_negatives"](spark, SF)
    theirs = con.sql(catalog.ORACLES["op13_hard_negatives"])
    assert dict(df.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint",
                               "positive_score": "bigint", "negative_score": "bigint"}
    order = [theirs.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in order) for r in theirs.fetchall())
