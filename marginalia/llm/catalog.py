"""One query per operator of this package, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (byte_bpe, disclosure, exact_dedup, hard_negatives, lang_id, lm_scoring, ngram_join, packing, quality, substring_dedup, token_alignment,
               token_counts, token_files)
from .common import documents


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = byte_bpe.byte_bpe_decode(byte_bpe.byte_bpe_encode(documents(spark, sf_dir), path, pattern), path, pattern)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.language_id(documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = token_counts.sample_edits(documents(spark, sf_dir))
    return token_counts.edited_token_counts(edited, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(documents(spark, sf_dir))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(documents(spark, sf_dir), order=3)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a_path, b_path = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return token_alignment.align_tokens(documents(spark, sf_dir), a_path, b_path, digest=True).withColumnRenamed("groups", "groups_sha256")


def op12_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure.find_disclosures(documents(spark, sf_dir))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[n(i).alias(f"n_{kind}") for i, kind in enumerate(disclosure.KINDS)],
                        F.sha2(disclosure.spans_text(F.col("base")), 256).alias("base_sha256"),
                        disclosure.spans_text(F.col("base"), F.col("added")).alias("spans"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    mined = hard_negatives.hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_language_id": op2_language_id,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_token_files": op7_token_files,
    "op8_quality_rules": op8_quality_rules,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_token_alignment": op11_token_alignment,
    "op12_disclosure": op12_disclosure,
    "op13_hard_negatives": op13_hard_negatives,
}

_FLOORS = ", ".join(f"('{rule}', {floor})" for rule, floor in quality.RULES.items())
ORACLES = {
    "op3_exact_dedup": """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
  doc_id is not distinct from max(doc_id) over w as kept, sha256(t) as text_sha256 from d window w as (partition by t)
""",
    "op8_quality_rules": rf"""
with d as (select doc_id, lang, source, coalesce(text, '') as text from documents),
words as (select doc_id, unnest(w) as w, unnest(range(1, len(w) + 1)) as i
  from (select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from d)),
grams as (select doc_id, i, lead(w, 7) over p as last, concat_ws(' ', w, lead(w, 1) over p, lead(w, 2) over p, lead(w, 3) over p,
    lead(w, 4) over p, lead(w, 5) over p, lead(w, 6) over p, lead(w, 7) over p) as g
  from words window p as (partition by doc_id order by i)),
found as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as n from grams where last is not null) where n > 1),
covered as (select doc_id, sum(least(8, coalesce(nxt - i, 8))) as n_repeat_words
  from (select *, lead(i) over (partition by doc_id order by i) as nxt from found) group by doc_id),
basis as (select doc_id, lang, source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) as n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
counts as (select b.doc_id, lang, source, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
    cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, len(lines) as n_lines
  from basis b left join covered c on b.doc_id = c.doc_id),
judged as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from counts),
ratios as (select doc_id, lang, source, base_failed, unnest(['symbols', 'length', 'lines', 'repeats']) as rule,
    unnest([n_symbols * 1000 // greatest(n_words, 1), word_chars * 1000 // greatest(n_words, 1),
      n_dup_lines * 1000 // greatest(n_lines, 1), n_repeat_words * 1000 // greatest(n_words, 1)]) as v from judged),
buckets as (select *, v - v % cast(2 ** greatest(length(bin(v)) - 5, 0) as bigint) as bucket from ratios where not base_failed),
leveled as (select 0 as level, lang, source, rule, bucket from buckets
  union all select 1, lang, null, rule, bucket from buckets union all select 2, null, null, rule, bucket from buckets),
cuts as (select level, lang, source, rule, count(*) as total, quantile_disc(bucket, 0.5) as q50, quantile_disc(bucket, 0.25) as q25
  from leveled group by all),
fences as (select level, lang, source, rule, total, q50 + {quality.FENCE} * greatest(q50 - q25, floor) as threshold
  from cuts join (values {_FLOORS}) as f(name, floor) on rule = name),
limits as (select o.lang, o.source, o.rule, case when o.total >= {quality.LEAST_ROWS} then o.threshold
    when l.total >= {quality.LEAST_ROWS} then l.threshold else w.threshold end as threshold
  from fences o join fences l on o.rule = l.rule and o.lang is not distinct from l.lang and l.level = 1
  join fences w on o.rule = w.rule and w.level = 2 where o.level = 0),
verdicts as (select r.doc_id, bool_and(r.v <= coalesce(t.threshold, -1)) as good from ratios r left join limits t
    on r.lang is not distinct from t.lang and r.source is not distinct from t.source and r.rule = t.rule group by r.doc_id)
select j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and good as kept
from judged j join verdicts v on j.doc_id = v.doc_id
""",
    "op13_hard_negatives": """
with given as (select row_number() over () as k, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, embedding
  from embeddings where label is not null and embedding is not null),
rows as (select k, vec_id, label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from given
  where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select a.k, a.vec_id as anchor_id, b.k as other, b.vec_id, a.label = b.label as same,
    cast(list_dot_product(a.v, b.v) as bigint) as score
  from rows a join rows b on a.vec_id % 100 = 0 and a.k <> b.k),
positives as (select *, row_number() over (partition by k order by score desc, vec_id, other) as place from scored where same
  qualify place <= 5),
pairs as (select p.anchor_id, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score,
    cast(row_number() over (partition by p.k, p.place order by n.score desc, n.vec_id, n.other) as integer) as rank
  from positives p join scored n on p.k = n.k and not n.same and 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from pairs where rank <= 5
""",
}
