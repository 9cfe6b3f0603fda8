"""Exact duplicates by deterministic block naming.

A text is cut into blocks of fixed size. Equal blocks get one integer name: rows are shuffled and
sorted by content, and the name is the place of the first of them. Neighbouring names are then named
in pairs, again by sorting, until each document has a single name; documents that are down to one
name leave the recursion. Two texts have the same (level, name) exactly if they are equal, so no hash
decides anything. Block hashes only tell which contents are frequent, to spread those.

Defined results: null text is the empty text; case of A to Z is ignored; of equal texts the row with
the largest ``doc_id`` stays (a null ``doc_id`` only if all are null); rows that repeat both
``doc_id`` and text are all counted and marked alike; an empty table gives an empty table.
Only ``doc_id`` and ``text`` are read, so further columns of any name are harmless.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..storage import materialize

BLOCK_BYTES = 4096
# Contents with this many rows are spread over groups of about so many rows each ...
SPREAD_ROWS = 1000
# ... and only the most frequent contents need that: any other has less than a ten-thousandth of the rows.
SPREAD_KEYS = 10_000
ROW = ["doc_id", "sha"]


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block of each text: ``doc_id, sha, idx, parts, block``; an empty text has one empty block."""
    rows = docs.select("doc_id", normalised(F.col("text")).alias("text"))
    rows = rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), F.col("text").cast("binary").alias("bytes"))
    last = F.greatest(F.ceil(F.octet_length("bytes") / block_bytes) - 1, F.lit(0)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("bytes"), i * block_bytes + 1, F.lit(block_bytes)))
    return rows.select(*ROW, (last + 1).alias("parts"), F.posexplode(cut).alias("idx", "block"))


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Replace the columns ``keys`` by one integer ``name``: equal for equal keys, different for others."""
    hashed = rows.withColumn("h", F.xxhash64(*keys))
    heavy = (
        hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SPREAD_ROWS)
        .orderBy(F.desc("n"), "h").limit(SPREAD_KEYS)
    )
    groups = F.ceil(F.col("n") / SPREAD_ROWS).cast("int")
    salt = F.coalesce(F.pmod(F.xxhash64(*ROW, "idx"), groups), F.lit(-1).cast("long"))
    # At most SPREAD_KEYS rows of two numbers.
    salted = hashed.join(F.broadcast(heavy), "h", "left").select(*ROW, "idx", "parts", *keys, salt.alias("salt"))
    group = [*keys, "salt"]
    placed = salted.repartition(*group).sortWithinPartitions(*group).withColumn("at", F.monotonically_increasing_id())
    first = placed.withColumn("name", F.min("at").over(W.partitionBy(*group)))
    stands_for = F.when((F.col("salt") >= 0) & (F.col("at") == F.col("name")), F.struct(*keys))
    named = materialize(first.select(*ROW, "idx", "parts", "name", stands_for.alias("key")), "names")
    # The groups of a spread content meet here, one row for each.
    own = named.filter("key is not null").select("name", "key")
    shared = own.groupBy("key").agg(F.min("name").alias("same"))
    same = materialize(own.join(shared, "key").select("name", "same"), "names")
    out = named.drop("key").join(same, "name", "left")
    return materialize(out.select(*ROW, "idx", "parts", F.coalesce("same", "name").alias("name")), "names")


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, sha, level, name``; (level, name) is the identity of its text."""
    names = _named(blocks(docs, block_bytes), ["block"])
    rows = names.filter("idx = 0").select(*ROW)
    found, level = [], 0
    while True:
        found.append(names.filter("parts = 1").select(*ROW, F.lit(level).alias("level"), "name").distinct())
        longer = names.filter("parts > 1")
        if longer.isEmpty():
            break
        # Rows that repeat doc_id and text fall together here.
        pairs = longer.groupBy(*ROW, F.floor(F.col("idx") / 2).cast("int").alias("idx")).agg(
            F.floor((F.max("parts") + 1) / 2).cast("int").alias("parts"),
            F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"))
        names = _named(pairs, ["left", "right"])
        level += 1
    ids = found[0]
    for more in found[1:]:
        ids = ids.unionByName(more)
    ids = ids.withColumnRenamed("doc_id", "_id").withColumnRenamed("sha", "_sha")
    return rows.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha"))).drop("_id", "_sha")


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    rows = materialize(identities(docs, block_bytes), "identities")
    groups = rows.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # Written first: a join of two plain scans lets Spark split a large group.
    joined = rows.join(materialize(groups, "groups"), ["level", "name"])
    return joined.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each text, with its columns."""
    kept = exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_kept")).distinct()
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", F.sha2(normalised(F.col("text")), 256).alias("_sha"))
    joined = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_kept")), "left_semi")
    nth = F.row_number().over(W.partitionBy("doc_id", "_sha").orderBy("_sha"))
    return joined.withColumn("_nth", nth).filter("_nth = 1").select("_row.*")
