"""One key holds a third of all rows: results stay whole and the hot key is split."""

import pytest
from pyspark.sql import functions as F

from marginalia.operators import code, records, reviews

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def tiny_limits(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot_reviews(spark, n=6000):
    """Every third review asks for the same key."""
    target = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id"))
    return spark.range(n, numPartitions=8).select(
        F.lit("p").alias("project"), F.lit("f").alias("path"), F.col("id").alias("record_no"),
        F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.col("id").alias("start_line"), F.col("id").alias("end_line"),
        F.concat(F.lit("{a``1``"), F.sha2(F.col("id").cast("string"), 512), F.lit("``1``n"), target.cast("string"), F.lit("``f}")).alias("review_message"),
    )


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    query = df._jdf.queryExecution()
    rows = df.collect()
    return rows, query.executedPlan().toString()


def test_hot_target_is_split(spark, tiny_limits):
    source = hot_reviews(spark)
    routed = reviews.next_signal(reviews.parse_reviews(source), records.function_index(source))
    rows, plan = final_plan(routed)
    assert len(rows) == 6000
    assert all(r["key"] == ("f:n7" if r["record_no"] % 3 == 0 else f"f:n{r['record_no']}") for r in rows)
    assert "skew=true" in plan


def test_hot_name_gives_no_pairs(spark, tiny_limits):
    same = hot_reviews(spark, 3000).withColumn("name", F.when(F.col("record_no") % 3 == 0, "main").otherwise(F.col("name")))
    asked = same.select("project", F.col("path").alias("next_path"), F.lit("main").alias("next_key"), F.col("record_no").alias("who"))
    found = code.find_function(asked, same)
    assert [tuple(r) for r in found.groupBy("found_record_no").count().collect()] == [(0, 3000)]


def test_hot_index_key_is_combined_before_the_shuffle(spark):
    same = hot_reviews(spark, 3000).withColumn("name", F.lit("main"))
    plan = records.function_index(same)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan
    assert records.function_index(same).count() == 1
