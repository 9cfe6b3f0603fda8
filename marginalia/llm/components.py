"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..storage import materialize


def components(links: DataFrame) -> DataFrame:
    """``links`` has columns ``a`` and ``b``; gives ``node, label``, the smallest node of its component.

    Nodes whose links are all to themselves are left out, as are links with a null end. Repeated links count once, and no
    links give no rows. Every round writes its links; the joins are between written
    tables, of which one has each node once, so that Spark can split a node with very many links.
    """
    pairs = links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    pairs = materialize(pairs, "links")
    known = None
    while True:
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = materialize(large, "links")
        least = materialize(large.groupBy("hi").agg(F.min("lo").alias("m")), "least")
        small = large.join(least, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        pairs = materialize(small.unionByName(least.withColumnRenamed("m", "lo")).distinct(), "links")
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == known:
            break
        known = now
    roots = pairs.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct()
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionByName(roots)
