"""Hard negatives of anchor vectors, scored by matrix products in a residue number system.

1. Components become whole numbers. A tile of rows and anchors is multiplied modulo several small primes: balanced
   residues as float32, no more dimensions at a time than keep a sum below 2^24, so that every product is exact.
   There are as many primes as the Cauchy-Schwarz bound of the tile needs; Chinese remaindering in mixed radix gives
   back the exact signed scores.
2. Rows are packed into blocks where they lie, anchors by hash of their key. Every row block meets every anchor block
   once: the stated query set against all rows. A task keeps the best few of each anchor it meets, and a window over
   those few gives the best of all.
3. The first pass finds each anchor's positives. The second takes, for each positive, the best rows of another label
   whose score lies in the window from ``low`` to ``high`` percent of the positive's.

Defined results: a row with a null label or vector, or with a null, NaN or infinite component takes no part, nor does
one whose whole numbers have a squared length of 2^52 or more, as its scores could leave the range that is exact. A
shorter vector counts as ending in zeros, an empty one scores 0. A row without an id is never an anchor and comes after
all others of its score. Ties go by id; rows that repeat are rows of their own, also to an anchor they repeat, which
gives its rows once for each time it is there. No anchors, no positives or no rows in a window give no rows. Only the
three columns named are read.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from math import isqrt

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..storage import materialize

PRIMES = (251, 241, 239, 233, 229, 227, 223, 211)
# Squared lengths stay below this, so that scores, their hundredfolds and products of primes fit 64 bits.
LIMIT = 1 << 52
# Values in a block of rows and of anchors, and rows in a block at most.
ROW_VALUES, ANCHOR_VALUES, BLOCK_ROWS = 1 << 20, 1 << 22, 8192
# Row blocks that meet an anchor block in one task where the two sides are shuffled.
BLOCKS_A_SALT = 16
# Anchors multiplied at a time, and anchor blocks whose best rows a task holds.
COLUMNS, HELD = 256, 8
NONE = -(1 << 63)


def exact_products(rows, anchors):
    """Inner products of whole numbers, ``rows x anchors``, as 64-bit integers; squared lengths below ``LIMIT``."""
    import numpy as np

    square = lambda m: int((m.astype(np.float64) ** 2).sum(1).max(initial=0))
    bound = isqrt(square(rows) * square(anchors)) + 1
    primes, product = [], 1
    while product <= 2 * bound:
        primes.append(PRIMES[len(primes)])
        product *= primes[-1]
    digits = []
    for p in primes:
        half = p // 2
        a, b = (((m + half) % p - half).astype(np.float32) for m in (rows, anchors))
        step = (1 << 24) // (half * half) - 1
        total = np.zeros((len(rows), len(anchors)), np.int64)
        for at in range(0, rows.shape[1], step):
            total += (a[:, at:at + step] @ b[:, at:at + step].T).astype(np.int64)
        # The next digit in mixed radix: what the digits so far leave, divided by the primes so far.
        weight = 1
        for digit, q in zip(digits, primes):
            total -= digit * weight
            weight = weight * q % p
        digits.append(total * pow(weight, -1, p) % p)
    score = np.zeros((len(rows), len(anchors)), np.int64)
    for digit, p in zip(reversed(digits), reversed(primes)):
        score = score * p + digit
    return np.where(score > product // 2, score - product, score)


def _pack(matrix) -> bytes:
    """Whole numbers in the narrowest width that holds them all; the first byte is the width."""
    import numpy as np

    most = max(int(matrix.max(initial=0)), -int(matrix.min(initial=0)))
    width = 1 if most < 1 << 7 else 2 if most < 1 << 15 else 4
    return bytes([width]) + matrix.astype(f"<i{width}").tobytes()


def _unpack(data: bytes, n: int):
    import numpy as np

    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64).reshape(n, -1)


def _matrix(column, dims: int):
    """A list column as rows of ``dims`` numbers, the shorter ones ending in zeros."""
    import numpy as np

    flat, ends = column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(flat) == len(column) * dims:
        return flat.reshape(len(column), dims)
    out = np.zeros((len(column), dims), np.int64)
    sizes = np.diff(ends, prepend=0)
    line = np.repeat(np.arange(len(column)), sizes)
    out[line, np.arange(len(flat)) - np.repeat(ends - sizes, sizes)] = flat
    return out


def _pack_rows(dims: int, n_salts: int):
    """Rows to blocks of rows."""

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        size = max(1, min(BLOCK_ROWS, ROW_VALUES // max(dims, 1)))
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids, keys = part.column("id"), part.column("key").to_numpy()
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(keys[0]) % n_salts], pa.int64()), pa.array([keys.tobytes()]),
                    pa.array([ids.fill_null(0).to_numpy().tobytes()]),
                    pa.array([ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()]),
                    pa.array([part.column("label").to_numpy().astype("<i8").tobytes()]),
                    pa.array([_pack(_matrix(part.column("numbers"), dims))])],
                    names=["salt", "keys", "ids", "without_id", "labels", "numbers"])

    return run


def _pack_anchors(dims: int, n_scores: int):
    """The anchors of a block to one row; ``scores`` has the scores of their positives, if any are known."""

    def run(table):
        import pyarrow as pa

        table = table.sort_by("key").combine_chunks()
        scores = [(list(s) + [NONE] * n_scores)[:n_scores] for s in table.column("scores").to_pylist()]
        return pa.Table.from_arrays([
            table.column("block")[:1], pa.array([table.column("key").to_numpy().tobytes()]),
            pa.array([table.column("label").to_numpy().astype("<i8").tobytes()]),
            pa.array([_pack(_matrix(table.column("numbers").combine_chunks(), dims))]), pa.array([sum(scores, [])], pa.list_(pa.int64()))],
            names=["block", "anchor_keys", "anchor_labels", "anchor_numbers", "scores"])

    return run


class _Best:
    """The best ``k`` rows of each of ``n`` columns so far, by score, id and key."""

    def __init__(self, n: int, k: int):
        import numpy as np

        self.k, self.floor = k, np.full(n, NONE)
        self.held = [np.zeros(0, np.int64) for _ in range(5)]  # column, score, without id, id, key

    def add(self, scores, first: int, without_id, ids, keys) -> None:
        """``scores`` is rows x columns from column ``first`` on; NONE where a row is no candidate."""
        import numpy as np

        n = scores.shape[1]
        low = np.maximum(self.floor[first:first + n], NONE + 1)
        if len(scores) > self.k:
            low = np.maximum(low, np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k])
        at, column = np.nonzero(scores >= low)
        new = [column + first, scores[at, column], without_id[at], ids[at], keys[at]]
        mine = (self.held[0] >= first) & (self.held[0] < first + n)
        both = [np.concatenate([h[mine], x]) for h, x in zip(self.held, new)]
        order = np.lexsort((both[4], both[3], both[2], -both[1], both[0]))
        both = [x[order] for x in both]
        place = np.arange(len(order)) - np.searchsorted(both[0], both[0])
        last = both[0][place == self.k - 1]
        self.floor[last] = both[1][place == self.k - 1]
        self.held = [np.concatenate([h[~mine], x[place < self.k]]) for h, x in zip(self.held, both)]


def _tiles(k: int, n_scores: int, low: int, high: int):
    """Tiles to the best rows of each anchor, or of each anchor and positive if ``n_scores``; partial results."""

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        held: OrderedDict = OrderedDict()

        def give(anchors, bests):
            for place, best in enumerate(bests):
                column, score, without_id, ids, row = best.held
                yield pa.RecordBatch.from_arrays([
                    pa.array(anchors[column]), pa.array(np.full(len(column), place + 1, np.int32)), pa.array(score),
                    pa.array(ids, mask=without_id.astype(bool)), pa.array(row)],
                    names=["anchor_key", "place", "score", "id", "row_key"])

        numbers = lambda x: np.frombuffer(x, "<i8")
        for batch in batches:
            for t in batch.to_pylist():
                keys, ids, labels, anchors = (numbers(t[n]) for n in ("keys", "ids", "labels", "anchor_keys"))
                without_id = np.frombuffer(t["without_id"], np.uint8).astype(np.int64)
                rows, columns, of = _unpack(t["numbers"], len(keys)), _unpack(t["anchor_numbers"], len(anchors)), numbers(t["anchor_labels"])
                known = np.array(t["scores"], np.int64).reshape(len(anchors), -1)
                if t["block"] not in held:
                    held[t["block"]] = anchors, [_Best(len(anchors), k) for _ in range(max(n_scores, 1))]
                held.move_to_end(t["block"])
                for at in range(0, len(anchors), COLUMNS):
                    cut = slice(at, at + COLUMNS)
                    score, same = exact_products(rows, columns[cut]), labels[:, None] == of[cut]
                    if not n_scores:
                        open_ = same & (keys[:, None] != anchors[cut])
                        held[t["block"]][1][0].add(np.where(open_, score, NONE), at, without_id, ids, keys)
                    for place in range(n_scores):
                        p = known[cut, place]
                        # A place without a positive has the lowest number: its products must not be formed.
                        p, there = np.where(p == NONE, 0, p), p != NONE
                        open_ = ~same & there & (low * p <= 100 * score) & (100 * score <= high * p)
                        held[t["block"]][1][place].add(np.where(open_, score, NONE), at, without_id, ids, keys)
                if len(held) > HELD:
                    yield from give(*held.popitem(last=False)[1])
        for anchors, bests in held.values():
            yield from give(anchors, bests)

    return run


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   scale: float = 256.0, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank, anchor_key``.

    ``is_anchor`` is a condition on ``vectors``. ``anchor_key`` tells rows with one id apart.
    """
    spark = vectors.sparkSession
    usable = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("vector", lambda x: F.floor(F.lit(float(scale)) * x))
    length = F.aggregate("numbers", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    taken = (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                       F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
        .filter(F.col("label").isNotNull() & F.col("vector").isNotNull()).filter(usable)
        .select("id", "label", (F.col("anchor") & F.col("id").isNotNull()).alias("anchor"), whole.alias("numbers"))
        .filter(length < float(LIMIT))
    )
    shards = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = materialize(taken.repartition(shards).withColumn("key", F.monotonically_increasing_id()), "vectors")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("anchor"), 1)).alias("anchors"), F.max(F.size("numbers")).alias("dims")).first()
    dims = total["dims"] or 0
    n_blocks = max(1, -(-total["anchors"] * max(dims, 1) // ANCHOR_VALUES))
    n_salts = max(1, total["n"] // (max(1, min(BLOCK_ROWS, ROW_VALUES // max(dims, 1))) * BLOCKS_A_SALT))
    packed = rows.drop("anchor").mapInArrow(
        _pack_rows(dims, n_salts), "salt long, keys binary, ids binary, without_id binary, labels binary, numbers binary")
    asked = rows.filter("anchor").withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks)))

    def best(anchors: DataFrame, k: int, n_scores: int) -> DataFrame:
        blocks = anchors.groupBy("block").applyInArrow(
            _pack_anchors(dims, n_scores), "block long, anchor_keys binary, anchor_labels binary, anchor_numbers binary, scores array<long>")
        # Written, so that Catalyst knows the size and sends it to the rows, or shuffles both, as that size asks.
        blocks = materialize(blocks, "anchors").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(n_salts - 1).cast("long"))))
        grid = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1).cast("long"))))
        found = grid.join(blocks, ["block", "salt"]).drop("salt").mapInArrow(
            _tiles(k, n_scores, low, high), "anchor_key long, place int, score long, id long, row_key long")
        order = W.partitionBy("anchor_key", "place").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row_key")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    first = best(asked.withColumn("scores", F.array().cast("array<long>")), positives, 0)
    first = materialize(first.select("anchor_key", F.col("rank").alias("place"), F.col("id").alias("positive_id"),
                                     F.col("score").alias("positive_score")), "positives")
    scores = first.groupBy("anchor_key").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("s"))
    known = asked.join(scores, asked["key"] == scores["anchor_key"]).select("block", "key", "label", "numbers", F.col("s.positive_score").alias("scores"))
    second = best(known, negatives, positives)
    named = first.join(asked.select(F.col("key").alias("anchor_key"), F.col("id").alias("anchor_id")), "anchor_key")
    return second.join(named, ["anchor_key", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
        F.col("place").alias("positive_rank"), "anchor_key")
