"""Jaccard join on sets of five-word runs, with Bayesian pruning of candidates.

1. Each text becomes a set of shingle hashes with a key; texts with equal sets are copies and go on as one.
2. MinHash bands put similar sets into a common bucket; links to a bucket's smallest set join them into
   coarse groups. Two sets of similarity 0.8 miss each other in all bands with probability 5e-6.
3. Each coarse group is compared in tiles of two blocks of bounded size, so that no task holds a group and
   no pair is written. In a tile MinHash values are compared a few at a time, and a pair is dropped when
   the posterior probability that its similarity reaches the threshold is below the tolerance; what is
   left is verified on the sets themselves.
4. Tiles give link counts and the components of their own links; those are joined to classes.

Defined results: a text of one to four words has one shingle, all of it; null texts and texts without
words link to nothing, each its own class; a null ``doc_id`` is no class's number unless all its members lack one;
rows that repeat are copies; an empty table gives an empty table. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

from pyspark.sql import DataFrame, Window as W, functions as F

from ..storage import materialize
from .components import components
from .words import hash_words, in_runs, shingle_set

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 6
TOLERANCE = 1e-6
# A block has about so many sets, or so many shingles if that is fewer sets.
BLOCK_SETS, BLOCK_SHINGLES = 256, 400_000


def minhashes(shingles, n: int = BANDS * ROWS):
    """``n`` MinHash values of a set that is not empty."""
    import numpy as np

    rng = np.random.default_rng(23)
    factor = rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(1, 1 << 63, n, dtype=np.uint64)
    low = np.full(n, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 512):
        np.minimum(low, (shingles[at:at + 512, None] * factor + shift).min(0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def set_key(shingles) -> int | None:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True) if len(shingles) else None


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, set_id, n_shingles, bands``: the key of the set is null if it is empty."""

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for rows in in_runs(zip(batch.column(0).to_pylist(), (t.as_py() for t in batch.column(1)))):
                hashes, at = hash_words([text for _, text in rows])
                out = []
                for i, (doc_id, _) in enumerate(rows):
                    shingles = shingle_set(hashes[at[i]:at[i + 1]], words)
                    bands = []
                    if len(shingles):
                        values = minhashes(shingles).reshape(BANDS, ROWS)
                        bands = [int.from_bytes(hashlib.blake2b(bytes([b]) + v.tobytes(), digest_size=8).digest(), "little", signed=True)
                                 for b, v in enumerate(values)]
                    out.append((doc_id, set_key(shingles), len(shingles), bands))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                                 names=["doc_id", "set_id", "n_shingles", "bands"])

    given = docs.select(F.col("doc_id").cast("long"), "text")
    return given.mapInArrow(run, "doc_id long, set_id long, n_shingles long, bands array<long>")


def coarse_groups(sketched: DataFrame) -> DataFrame:
    """``set_id, coarse`` of the sets that share a bucket with another set, directly or over others."""
    placed = sketched.filter("set_id is not null").select("set_id", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("set_id").alias("a"), F.max("set_id").alias("z")).filter("a < z")
    centre = materialize(shared.select("bucket", "a"), "buckets")
    links = placed.join(centre, "bucket").select("a", F.col("set_id").alias("b"))
    return components(links).withColumnsRenamed({"node": "set_id", "label": "coarse"})


def least_matches(n: int, similarity: float, tolerance: float) -> int:
    """The fewest equal values among ``n`` with which a similarity that reaches ``similarity`` is still probable.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose tail is a binomial sum.
    """
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * similarity ** m * (1 - similarity) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n + 1


def linked_pairs(sets: list, left, right, similarity: float = SIMILARITY, tolerance: float = TOLERANCE):
    """Index pairs (one of ``left``, one of ``right``) whose sets are similar; pairs are pruned, then verified."""
    import numpy as np

    values = np.stack([minhashes(s) for s in sets])
    size = np.array([len(s) for s in sets])
    a, b = np.meshgrid(np.asarray(left), np.asarray(right), indexing="ij")
    a, b = a.ravel(), b.ravel()
    a, b = a[a != b], b[a != b]
    small, large = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
    near = small * 1_000_000 >= round(similarity * 1_000_000) * large  # no smaller set can be similar enough
    a, b = a[near], b[near]
    matches, step = np.zeros(len(a), np.int32), 24
    for at in range(0, values.shape[1], step):
        if not len(a):
            break
        for k in range(at, at + step):
            matches += values[a, k] == values[b, k]
        alive = matches >= least_matches(at + step, similarity, tolerance)
        a, b, matches = a[alive], b[alive], matches[alive]
    if not len(a):
        return a, b
    # Exact: shingles that two sets of the tile share, as columns of a table of zeros and ones.
    rows = np.unique(np.concatenate([a, b]))
    owner = np.repeat(np.arange(len(rows)), size[rows])
    _, column, times = np.unique(np.concatenate([sets[r] for r in rows]), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    place = np.zeros(len(sets), np.int64)
    place[rows] = np.arange(len(rows))
    if len(a) > 8 * len(rows):
        both = np.zeros((len(rows), len(rows)), np.float32)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        width = 1 << 13
        for first in range(0, int(column.max(initial=-1)) + 1, width):
            lo, hi = np.searchsorted(column, [first, first + width])
            table = np.zeros((len(rows), width), np.float32)
            table[owner[lo:hi], column[lo:hi] - first] = 1
            both += table @ table.T
        common = both[place[a], place[b]].astype(np.int64)
    else:
        common = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b)])
    # Whole numbers decide, so that a similarity of just the threshold counts.
    good = common * 1_000_000 >= round(similarity * 1_000_000) * (size[a] + size[b] - common)
    return a[good], b[good]


def _tile(pdf):
    """Links within one tile: each set's count and the smallest set it is connected with here."""
    import numpy as np
    import pandas as pd

    sets, keys, sides = [], [], []
    seen = set()
    for rows in in_runs(zip(pdf["set_id"], pdf["block"], pdf["text"])):
        hashes, at = hash_words([text for *_, text in rows])
        for i, (key, block, _) in enumerate(rows):
            shingles = shingle_set(hashes[at[i]:at[i + 1]], WORDS)
            # A doc_id may be repeated with another text.
            if key not in seen and set_key(shingles) == key:
                seen.add(key)
                sets.append(shingles)
                keys.append(key)
                sides.append(block)
    keys, sides = np.array(keys, np.int64), np.array(sides, np.int64)
    one, two = pdf["one"].iloc[0], pdf["two"].iloc[0]
    left, right = np.flatnonzero(sides == one), np.flatnonzero(sides == two)
    if len(left) and len(right):
        a, b = linked_pairs(sets, left, right)
        if one == two:
            a, b = a[a < b], b[a < b]
    else:
        a = b = np.zeros(0, np.int64)
    links = np.bincount(a, minlength=len(keys)) + np.bincount(b, minlength=len(keys))
    root = keys.copy()
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        if (before == root).all():
            break
    out = pd.DataFrame({"set_id": keys, "n_links": links, "root": root})
    return out[out["n_links"] > 0]


def set_keys(text):
    """The key of each text's set, as ``sketches`` gives it."""
    @F.pandas_udf("long")
    def keys(texts):
        import pandas as pd

        out = []
        for rows in in_runs((t,) for t in texts):
            hashes, at = hash_words([t for t, in rows])
            out += [set_key(shingle_set(hashes[at[i]:at[i + 1]], WORDS)) for i in range(len(rows))]
        return pd.Series(out, dtype="Int64")

    return keys(text)


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` as ``doc_id, set_id``; and of each set that is not empty its class, smallest ``doc_id`` and counts."""
    sketched = materialize(sketches(docs), "sketches")
    members = sketched.select("doc_id", "set_id", "n_shingles")
    sets = sketched.filter("set_id is not null").groupBy("set_id").agg(
        F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("n_copies"))
    sets = materialize(sets, "sets")
    coarse = materialize(coarse_groups(sketched).join(sets, "set_id").select("set_id", "coarse", "first_id", "n_shingles"), "coarse")
    sizes = coarse.groupBy("coarse").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    blocked = coarse.join(materialize(sizes, "sizes"), "coarse").withColumn("block", F.pmod(F.xxhash64("set_id"), "blocks").cast("int"))
    # Rows without a doc_id are told apart by their sets.
    texts = docs.select(F.col("doc_id").cast("long"), "text", set_keys(F.when(F.col("doc_id").isNull(), F.col("text"))).alias("key"))
    wanted = F.when(F.col("first_id").isNull(), F.col("set_id"))
    full = blocked.join(texts, F.col("first_id").eqNullSafe(F.col("doc_id")) & wanted.eqNullSafe(F.col("key")))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tiled = full.select("set_id", "coarse", "block", "text", others).select(
        "set_id", "coarse", "block", "text", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    found = tiled.groupBy("coarse", "one", "two").applyInPandas(_tile, "set_id long, n_links long, root long")
    found = materialize(found, "links")
    counts = found.groupBy("set_id").agg(F.sum("n_links").alias("n_links"))
    labels = components(found.select(F.col("set_id").alias("a"), F.col("root").alias("b")))
    classed = sets.join(labels, sets["set_id"] == labels["node"], "left").join(counts, "set_id", "left").select(
        "set_id", "first_id", "n_copies", F.coalesce("label", "set_id").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    classed = materialize(classed, "classes")
    names = materialize(classed.groupBy("label").agg(F.min("first_id").alias("class_id")), "classes")
    return members, materialize(classed.join(names, "label"), "classes")


def ngram_jaccard_join(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, n_links, n_copies``.

    ``class_id`` is the smallest ``doc_id`` of the class; ``n_links`` counts other sets of at least the
    similarity, each once however many copies it has; ``n_copies`` counts the rows with the same set.
    """
    members, classes = _classes(docs)
    by_set = classes.select("set_id", "class_id", "n_links", "n_copies")
    out = members.join(by_set, "set_id", "left")
    return out.select("doc_id", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """Of each class one row that gives it its number, with the columns of ``docs``.

    A ``doc_id`` may stand for several classes, and a null one for any number. Rows without words all stay, but for rows
    that repeat with their ``doc_id``.
    """
    _, classes = _classes(docs)
    first = classes.filter(F.col("first_id").eqNullSafe(F.col("class_id"))).groupBy("label").agg(
        F.first("class_id").alias("_id"), F.min("set_id").alias("_key"))
    kept = materialize(first.select("_id", "_key"), "kept")
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_doc"), set_keys(F.col("text")).alias("_set"))
    with_words = rows.join(kept, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_set") == F.col("_key")), "left_semi")
    # Rows without words and ids stay as they are; they would all be one key.
    bare = rows.filter("_set is null and _doc is null").select("_row.*")
    rest = with_words.withColumn("_hash", F.lit(0).cast("long")).unionByName(
        rows.filter("_set is null and _doc is not null").withColumn("_hash", F.xxhash64("_row")))
    nth = F.row_number().over(W.partitionBy("_doc", "_set", "_hash").orderBy(F.xxhash64("_row")))
    return rest.withColumn("_nth", nth).filter("_nth = 1").select("_row.*").unionByName(bare)
