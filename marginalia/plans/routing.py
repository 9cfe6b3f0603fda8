"""Serving many reviews from one set of keys as if they came one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import text as tx
from ..operators.reviews import suffix_index
from ..storage import materialize


def route_reviews(parsed: DataFrame, index: DataFrame, taken: DataFrame, order: str = "seq") -> DataFrame:
    """``project, order, status, key, next_key, next_path`` for each review.

    Reviews of a project are served in ``order``: each takes its exact key if that is left, else the
    smallest key left that ends with its name. All ask at once; a key stays with the earliest review
    that asked for it and the others ask for their next choice, until nobody is turned down. As
    every key prefers the earlier review, this ends in the same assignment as serving one by one.

    Reviews that ask for one name are ranked and ask for different keys at once: a key that an earlier one
    of them asks for, or was turned down at, is out of reach for the later ones. So rounds come from
    reviews that meet over different names, not from the number of reviews of one name.
    """
    asks = materialize(
        parsed.select("project", order, "n_parts", "continue_flag", "next_name",
                      tx.index_key(F.col("next_path"), F.col("next_name")).alias("probe")),
        "asks",
    )
    live = asks.filter((F.col("n_parts") >= tx.MIN_PARTS) & (F.col("continue_flag") == "1"))
    # Only keys that somebody may get, without those already taken.
    exact = (
        index.join(live.select("project", F.col("probe").alias("key")).distinct(), ["project", "key"], "left_semi")
        .join(taken, ["project", "key"], "left_anti")
    )
    near = materialize(
        suffix_index(index).withColumnRenamed("suffix", "next_name")
        .join(live.select("project", "next_name").distinct(), ["project", "next_name"], "left_semi")
        .join(taken, ["project", "key"], "left_anti")
        .withColumn("pos", F.row_number().over(W.partitionBy("project", "next_name").orderBy("key"))),
        "near-keys",
    )
    first = (
        live.join(exact.select("project", F.col("key").alias("probe"), "path"), ["project", "probe"], "left")
        .withColumn("key", F.when(F.col("path").isNotNull(), F.col("probe")))
        .withColumn("how", F.when(F.col("path").isNotNull(), "exact"))
        .withColumn("after", F.lit(0))
        .select("project", order, "next_name", "key", "path", "how", "after",
                F.col("path").isNull().alias("asking"))
    )
    state = materialize(first, "asking")
    while True:
        # Each review turned down asks for the key behind its own last one and behind those of the earlier ones.
        same_name = W.partitionBy("project", "next_name").orderBy(order)
        nth = F.row_number().over(same_name)
        choice = (
            state.filter("asking").withColumn("_nth", nth)
            .withColumn("pos", F.col("_nth") + F.max(F.col("after") + 1 - F.col("_nth")).over(same_name))
            .select("project", order, "next_name", "pos")
            .join(near, ["project", "next_name", "pos"])
            .select("project", order, F.struct("key", "path", "pos").alias("_c"))
        )
        turn = F.col("asking")
        asked = state.join(choice, ["project", order], "left").select(
            "project", order, "next_name",
            F.coalesce("_c.pos", "after").alias("after"),
            F.when(turn, F.col("_c.key")).otherwise(F.col("key")).alias("key"),
            F.when(turn, F.col("_c.path")).otherwise(F.col("path")).alias("path"),
            F.when(turn & F.col("_c").isNotNull(), "suffix").otherwise(F.col("how")).alias("how"),
        )
        asked = materialize(asked, "asked")
        holder = asked.filter(F.col("key").isNotNull()).groupBy("project", "key").agg(F.min(order).alias("_holder"))
        lost = F.coalesce(F.col(order) > F.col("_holder"), F.lit(False))
        state = materialize(
            asked.join(holder, ["project", "key"], "left").select(
                "project", order, "next_name",
                F.when(~lost, F.col("key")).alias("key"), F.when(~lost, F.col("path")).alias("path"),
                F.when(~lost, F.col("how")).alias("how"),
                "after", lost.alias("asking"),
            ),
            "asking",
        )
        if state.filter("asking").isEmpty():
            break
    status = (
        F.when(F.col("n_parts") < tx.MIN_PARTS, "malformed").when(F.col("continue_flag") != "1", "done")
        .otherwise(F.coalesce("how", F.lit("not_found")))
    )
    served = state.select("project", order, "key", F.col("path").alias("next_path"), "how")
    return asks.join(served, ["project", order], "left").select(
        "project", order, status.alias("status"), "key",
        F.when(F.col("key").isNotNull(), F.col("next_name")).alias("next_key"), "next_path",
    )
