"""From raw documents to packed training sequences.

Each stage reads the rows and texts its predecessor left. Quality rules reject documents, exact dedup keeps one of
equal texts, the Jaccard join keeps one document of each near-duplicate class, substring dedup cuts passages that an
earlier document has (and drops a document of which nothing is left), and packing places what remains.

Defined results: quality rules reject null, empty and very short texts, whose words are too few. Texts of any length are
read whole. Rows that repeat count as copies: one stays, by the largest doc_id in exact dedup and by the smallest in the
Jaccard join; rows without a doc_id are told apart by their texts. Rows that share a doc_id and differ in text stay
different documents, to the last stage. An empty table gives an empty table. Further columns are carried on unchanged
by all stages but the last; ``n_chars`` follows the text where words are cut.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import exact_dedup as exact, ngram_join, packing, quality, substring_dedup as substring
from marginalia.storage import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.kept_documents(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.kept_documents(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.without_passages(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]
# SQL has no tokenizer and no alignment; the tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
