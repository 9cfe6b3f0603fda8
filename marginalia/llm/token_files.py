"""Token ids in compact files, and reading them back.

The format: a folder with two Parquet tables. ``blocks`` holds runs of documents in ascending
``doc_id`` order: shard and block numbers, the ids before the block in its shard, the documents' keys
and lengths, one stream of control bytes and one of data bytes. An id is replaced by its rank by
frequency in the corpus (the most frequent is 0) and written in as few whole bytes as it needs,
smallest first; a control byte holds the byte counts less one of four ids, two bits each, the first in
the lowest. ``ranks`` lists the id of each rank. Parquet carries the bytes to whatever store Spark writes.

Defined results: a null text holds the end id only; a document of any length lies whole in one block;
rows that repeat a ``doc_id`` are kept and lie next to each other, ordered by content; a null
``doc_id`` comes first; an empty table gives files without blocks. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..storage import run_dir
from .word_ids import word_ids

BLOCK_IDS = 1 << 20
PLACE = "block int, before long, doc_ids array<long>, lengths array<long>, n_ids long"


def pack(ranks) -> tuple[bytes, bytes]:
    """Control and data bytes of an array of ranks below 2**32."""
    import numpy as np

    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    code = np.pad(code.astype(np.uint8), (0, -len(code) % 4)).reshape(-1, 4)
    return (code << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int):
    """The ranks again, by a table of the four byte counts that each control byte stands for."""
    import numpy as np

    table = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8)
    code = table[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(code + 1, dtype=np.int64) - code - 1
    raw = np.frombuffer(data, np.uint8)
    ranks = raw[at].astype(np.uint32)
    for byte in (1, 2, 3):
        more = np.flatnonzero(code >= byte)
        ranks[more] |= raw[at[more] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return ranks


def _table(rows: list[list], streams: list[str]):
    """Block rows as an Arrow batch: the columns of ``PLACE`` and byte streams."""
    import pyarrow as pa

    kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), *[pa.binary()] * len(streams)]
    names = ["block", "before", "doc_ids", "lengths", "n_ids", *streams]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def id_blocks(docs: DataFrame, path: str, end_id: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The documents' ids in ascending ``doc_id`` order: ``shard``, the columns of ``PLACE`` and ``ids``.

    Texts are sorted, not ids, so that each is tokenized once; ``ids`` has two bytes an id where that is enough.
    """

    def run(batches: Iterator):
        import numpy as np

        encode, end = word_ids(path).encode, end_id.to_bytes(4, "little")
        block, before, keys, parts, held = 0, 0, [], [], 0

        def flush():
            nonlocal block, before, keys, parts, held
            ids = np.concatenate(parts)
            row = [block, before, keys, [len(p) for p in parts], held, ids.astype("<u2" if ids.max() < 1 << 16 else "<u4").tobytes()]
            block, before, keys, parts, held = block + 1, before + held, [], [], 0
            return _table([row], ["ids"])

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                part = np.frombuffer(encode(text.as_py()) + end, "<u4")
                if held and held + len(part) > block_ids:
                    yield flush()
                keys.append(key.as_py())
                parts.append(part)
                held += len(part)
        if held:
            yield flush()

    spark = docs.sparkSession
    shards = max(1, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    given = docs.select(F.col("doc_id").cast("long"), "text").withColumn("tie", F.xxhash64("text"))
    ordered = given.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    return ordered.mapInArrow(run, f"{PLACE}, ids binary").select(F.spark_partition_id().alias("shard"), "*")


def _ids(stream: bytes, n: int):
    import numpy as np

    return np.frombuffer(stream, "<u2" if len(stream) == 2 * n else "<u4")


def id_counts(blocks: DataFrame) -> DataFrame:
    """``id, n`` over all blocks; each task sums up its own blocks first."""

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(1, np.int64)
        for batch in batches:
            for n, ids in zip(batch.column(0), batch.column(1)):
                seen = np.bincount(_ids(ids.as_py(), n.as_py()))
                if len(seen) > len(total):
                    seen, total = total, seen.astype(np.int64)
                total[:len(seen)] += seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    return blocks.select("n_ids", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int, block_ids: int = BLOCK_IDS) -> None:
    spark = docs.sparkSession
    raw = run_dir(spark, "ids")
    id_blocks(docs, path, end_id, block_ids).write.option("compression", "zstd").parquet(raw)
    blocks = spark.read.parquet(raw)
    # One row per id of the vocabulary at most, here and in each task.
    by_rank = [r["id"] for r in id_counts(blocks).orderBy(F.desc("n"), "id").collect()]
    spark.createDataFrame([(r, i) for r, i in enumerate(by_rank)], "rank long, id long").coalesce(1).write.parquet(f"{folder}/ranks")

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        rank_of = np.zeros(max(by_rank, default=0) + 1, np.uint32)
        rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
        for batch in batches:
            for *place, ids in zip(*batch.columns):
                place = [p.as_py() for p in place]
                yield _table([[*place[1:], *pack(rank_of[_ids(ids.as_py(), place[5])])]], ["control", "data"]).add_column(
                    0, "shard", pa.array([place[0]], pa.int32()))

    coded = blocks.select("shard", "block", "before", "doc_ids", "lengths", "n_ids", "ids").mapInArrow(
        run, f"shard int, {PLACE}, control binary, data binary")
    coded.write.option("compression", "zstd").parquet(f"{folder}/blocks")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: ``doc_id, start, ids``; ``start`` counts the ids of all documents before it."""
    id_of = [r["id"] for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()]  # the vocabulary
    blocks = spark.read.parquet(f"{folder}/blocks")
    # One row per shard.
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    starts = totals.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("shard_start"))
    placed = blocks.join(starts, "shard").select(
        (F.col("shard_start") + F.col("before")).alias("start"), "doc_ids", "lengths", "control", "data")

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        table = np.array(id_of, dtype="<u4")
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                ids = table[unpack(row["control"], row["data"], int(lengths.sum()))]
                ends = np.cumsum(lengths)
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - lengths, pa.int64()),
                    pa.array([ids[a:b].tobytes() for a, b in zip(ends - lengths, ends)], pa.binary())],
                    names=["doc_id", "start", "ids"])

    return placed.mapInArrow(run, "doc_id long, start long, ids binary")


def crc32_of_ids(read: DataFrame) -> DataFrame:
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.crc32("ids").alias("ids_crc32"))


def write_and_read(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Write the files into the shared folder and read each document's place, length and checksum from them."""
    folder = run_dir(docs.sparkSession, "token-files")
    write_token_files(docs, folder, path, end_id)
    return crc32_of_ids(read_token_files(docs.sparkSession, folder))
