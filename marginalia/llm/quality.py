"""Quality rules: counts of each text, then thresholds learned per language and source.

The learned part is a log-linear quantile sketch held as rows ``(lang, source, rule, bucket, n)``.
Two sketches merge by adding counts, so a source with few documents takes the sketch of its
language, or of the whole corpus. A rule's threshold is ``median + fence * spread``, where the spread
is the distance from the lower quartile to the median, at least the rule's floor: junk in the upper
half of a group does not move it.

Defined results: a null text has no words and fails the base rules; null languages and sources are
groups like others; repeated rows are judged like any row; an empty table gives an empty table.
Only the columns named are read, so further columns of any name are harmless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..storage import materialize

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
WINDOW = 8
# Rule: its smallest spread, in thousandths of the rule's ratio. FENCE times the floor of "repeats" stays inside its base rule (300).
RULES = {"symbols": 10, "length": 200, "lines": 35, "repeats": 20}
FENCE = 10
LEAST_ROWS = 200


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of ``text``, ``n_lines`` (with a word) and ``base_failed``; all built-in expressions.

    Windows of eight words are compared by 64-bit hashes of their words' hashes.
    """
    wh, win, srt = F.col("_wh"), F.col("_win"), F.col("_srt")
    blank = "\x20\x09\x0a\x0b\x0c\x0d"
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.length(F.translate(x, blank, "")) > 0)
    last = F.size(win) - 1

    def same(i: Column) -> Column:
        return F.get(srt, i)["h"] == F.get(srt, i - 1)["h"]

    starts = F.sort_array(F.filter(F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.when(((i > 0) & same(i)) | ((i < last) & same(i + 1)), F.get(srt, i)["i"]),
    ), lambda x: x.isNotNull()))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["n"] + x + WINDOW - F.greatest(x, a["end"])).alias("n"), (x + WINDOW).alias("end")),
        lambda a: a["n"],
    )
    words = docs.withColumn("_words", F.filter(F.split(whole, "[\\x20\\x09-\\x0D]+"), lambda x: x != ""))
    counted = (
        words.withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.translate(whole, blank, "")).cast("long"))
        .withColumn("n_symbols", (F.length(whole) - F.length(F.translate(whole, "#*$%&|<>", ""))).cast("long"))
        .withColumn("_lines", lines)
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("_wh", F.transform("_words", lambda w: F.xxhash64(w)))
    )
    eight = F.when(F.size(wh) > WINDOW, F.transform(
        F.sequence(F.lit(0), F.size(wh) - WINDOW), lambda i: F.xxhash64(*[F.get(wh, i + k) for k in range(WINDOW)])))
    found = counted.withColumn("_win", eight).withColumn("_srt", F.when(
        F.size(F.array_distinct(win)) < F.size(win),
        F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    found = found.withColumn("n_repeat_words", F.when(srt.isNotNull(), covered).otherwise(F.lit(0).cast("long")))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return found.withColumn("base_failed", failed).drop("_words", "_lines", "_wh", "_win", "_srt")


def _ratios() -> dict[str, Column]:
    """Each rule's ratio in whole thousandths."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    parts = {"symbols": ("n_symbols", words), "length": ("word_chars", words),
             "lines": ("n_dup_lines", lines), "repeats": ("n_repeat_words", words)}
    return {rule: F.floor(F.col(top) * 1000 / below).cast("long") for rule, (top, below) in parts.items()}


def _bucket(value: Column) -> Column:
    """The lower edge of the value's bucket: exact below 32, then sixteen buckets to an octave."""
    shift = F.greatest(F.length(F.bin(value)) - 5, F.lit(0))
    unit = F.pow(F.lit(2.0), shift).cast("long")
    return value - value % unit


def sketch(counted: DataFrame) -> DataFrame:
    """One row per language, source, rule and bucket; a hot source is summed up before the shuffle."""
    ratios = F.array(*[F.struct(F.lit(rule).alias("rule"), _bucket(v).alias("bucket")) for rule, v in _ratios().items()])
    return (
        counted.filter(~F.col("base_failed"))
        .select("lang", "source", F.explode(ratios).alias("r"))
        .groupBy("lang", "source", "r.rule", "r.bucket").agg(F.count(F.lit(1)).alias("n"))
    )


def thresholds(counted: DataFrame, fence: int = FENCE, least_rows: int = LEAST_ROWS) -> DataFrame:
    """One row per language and source with a threshold for each rule: ``t_symbols`` and so on."""
    own = materialize(sketch(counted), "sketch")
    own.createOrReplaceTempView("_quality_sketch")
    spark = own.sparkSession
    floors = ", ".join(f"('{rule}', {floor})" for rule, floor in RULES.items())
    # Level 0 is the pair itself, 1 its language, 2 everything; merging adds the counts of equal buckets.
    long = spark.sql(f"""
with merged as (
  select 0 as level, lang, source, rule, bucket, n from _quality_sketch
  union all select 1, lang, cast(null as string), rule, bucket, sum(n) from _quality_sketch group by lang, rule, bucket
  union all select 2, cast(null as string), cast(null as string), rule, bucket, sum(n) from _quality_sketch group by rule, bucket
), summed as (
  select *, sum(n) over (partition by level, lang, source, rule order by bucket) as upto,
    sum(n) over (partition by level, lang, source, rule) as total from merged
), cuts as (
  select level, lang, source, rule, max(total) as total,
    min(case when upto * 2 >= total then bucket end) as q50, min(case when upto * 4 >= total then bucket end) as q25
  from summed group by level, lang, source, rule
), fences as (
  select level, lang, source, rule, total, q50 + {int(fence)} * greatest(q50 - q25, floor) as threshold
  from cuts join (values {floors}) as f(name, floor) on rule = name
)
select o.lang, o.source, o.rule, case when o.total >= {int(least_rows)} then o.threshold
    when l.total >= {int(least_rows)} then l.threshold else w.threshold end as threshold
from fences o join fences l on o.rule = l.rule and o.lang <=> l.lang join fences w on o.rule = w.rule
where o.level = 0 and l.level = 1 and w.level = 2
""")
    wide = long.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("rule") == rule, F.col("threshold"))).alias(f"t_{rule}") for rule in RULES])
    return materialize(wide, "thresholds")


def judge(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """Add ``kept``: the base rules hold and no ratio is above the threshold of its language and source.

    A pair without thresholds has no document that passed the base rules, so nothing of it is kept.
    """
    limits = limits.withColumnRenamed("lang", "_lang").withColumnRenamed("source", "_source")
    joined = counted.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    good = ~F.col("base_failed")
    for rule, ratio in _ratios().items():
        good = good & (ratio <= F.col(f"t_{rule}"))
    return joined.withColumn("kept", F.coalesce(good, F.lit(False))).select(*counted.columns, "kept")


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts and verdict of each row, by ``doc_id``; texts are read once and only counts are stored."""
    given = docs.select("doc_id", "lang", "source", "text")
    counted = materialize(with_counts(given).drop("text"), "quality-counts")
    return judge(counted, thresholds(counted))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns. Texts are counted again and not shuffled."""
    given = docs.select("doc_id", "lang", "source", "text")
    limits = thresholds(materialize(with_counts(given).drop("text", "doc_id"), "quality-counts"))
    rows = docs.select(F.struct("*").alias("_row"), "lang", "source", "text")
    return judge(with_counts(rows), limits).filter("kept").select("_row.*")
