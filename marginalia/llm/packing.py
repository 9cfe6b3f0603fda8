"""Best-fit packing of tokenized documents into sequences of fixed length.

Documents are cut into pieces of at most ``capacity`` ids, and pieces of equal length are alike, as
are sequences with equal room. So the sweeps run over classes, of which there are never more than
``capacity``: lengths are taken from the longest down; in one superstep all pieces of a length go, in
the order of their ranks, to the successors among the gaps (the smallest room that holds them, one
piece each), the moved gaps are put back with what is left of them, and pieces that find no gap open
sequences. The rows themselves never leave the executors: a distributed range sort ranks the pieces
within their length, and each task looks up the place of its pieces by length and rank.

Defined results: a null or empty text is its end id alone; repeated rows are packed like any rows; a
text of any length is cut whole; an empty table gives an empty table. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window as W, functions as F

from ..storage import materialize
from .common import give_back
from .word_ids import word_ids

CAPACITY = 2048
END_ID = 0
# Pieces whose ids a worker keeps between tasks.
CACHED = 300_000


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each piece; the ids themselves are not carried on."""

    def run(batches: Iterator):
        import zlib

        import pyarrow as pa

        encode, end = word_ids(path, cached=CACHED).encode, end_id.to_bytes(4, "little")
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0), batch.column(1)):
                ids, doc_id = encode(text.as_py()) + end, key.as_py()
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at:at + 4 * capacity]
                    rows.append((doc_id, n, at // 4, len(cut) // 4, zlib.crc32(cut)))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    given = docs.select(F.col("doc_id").cast("long"), "text")
    return given.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def place_classes(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit by classes: ``(length, first rank, how many, first sequence, offset)``.

    ``counts`` has the number of pieces of each length. Gaps are runs of sequences with equal room.
    """
    rooms: list[int] = []  # the rooms that some run has, ascending
    runs: dict[int, list[tuple[int, int]]] = {}
    places, opened = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room:
            if room not in runs:
                insort(rooms, room)
                runs[room] = []
            runs[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                n = -(-left // (capacity // length))
                put(capacity, opened, n)
                opened += n
                continue
            room = rooms[at]
            first, n = runs[room].pop()
            taken = min(n, left)
            if n > taken:
                runs[room].append((first + taken, n - taken))
            elif not runs[room]:
                del runs[room], rooms[at]
            places.append((length, rank, taken, first, capacity - room))
            put(room - length, first, taken)
            left, rank = left - taken, rank + taken
    return places


def best_fit_packing(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` from 1 to ``capacity``."""
    names = cut.columns
    shards = max(cut.sparkSession.sparkContext.defaultParallelism, int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.desc("length"), "doc_id", "piece", "ids_crc32"]
    ranged = cut.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    rows = materialize(ranged.select(*names, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "ranked")
    # Each part's first rank within a length: one row per part and length.
    parts = rows.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
    upto = F.sum("n").over(W.partitionBy("length").orderBy("_part"))
    parts = materialize(parts.select("length", "_part", "n", (upto - F.col("n") - F.col("_first")).alias("_shift")), "ranks")
    # One row per length, so never more than the capacity.
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = place_classes(counts, capacity)
    ranked = rows.join(parts.drop("n"), ["length", "_part"]).select(*names, (F.col("_at") + F.col("_shift")).alias("_rank"))

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        table = np.array(sorted(places), np.int64).reshape(-1, 5)
        keys = table[:, 0] << 48 | table[:, 1]
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, batch.column("length").to_numpy() << 48 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([
                *[batch.column(n) for n in names], pa.array(table[at, 3] + rank - table[at, 1]), pa.array(table[at, 4])],
                names=[*names, "sequence_id", "offset"])

    schema = cut.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenize, cut and pack: one row per piece."""
    # Written first: the range sort reads its rows twice, and they are to be tokenized once.
    return best_fit_packing(materialize(pieces(docs, path, capacity, end_id), "pieces"), capacity)
