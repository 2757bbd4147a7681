"""From raw documents to packed training sequences.

Language ID drops documents whose language is rejected, the n-gram Jaccard join keeps one document of each group of near
duplicates, the secret scan blanks secrets, mixing brings sources to their target weights, and packing cuts what is left
into sequences. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from linkweave.llm import language_id, mixing, ngram_join, packing, secret_scan
from linkweave.llm.common import removed, shared_dir, table

MIX = mixing.MixPlan(
    budget_percent=100, max_epochs=4, seed=23,
    weights={"domain": {"d0": 3, "d1": 3, "d2": 2, "d3": 2}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}},
)


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_corpus(docs, MIX)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_languages),
    ("ngram_join", drop_near_duplicates),
    ("secret_scan", blank_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Training, component search and tokenization have no SQL form; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read as the next one's input,
    after which what it was made from goes."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        folder = shared_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        if before:
            removed(spark, before)
        docs, before = spark.read.parquet(folder), folder
    return STAGES[-1][1](spark, docs, sf_dir)
