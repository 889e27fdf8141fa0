"""Corpus pipeline: language ID, exact dedup, near dedup, secret redaction and packing of documents.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; run() writes every
stage's result to the shared folder and reads it again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meridian.llm.common import materialize, table
from meridian.llm.exact_dedup import drop_duplicates
from meridian.llm.langid import keep_identified
from meridian.llm.ngram_join import keep_one_of_each
from meridian.llm.packing import pack
from meridian.llm.secrets import redact


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those that no learned language codes well."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the largest doc_id of equal texts."""
    return drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group linked by 5-word shingles at 0.8 or more."""
    return keep_one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the secrets found in a text; keeps every document."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their places in sequences."""
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_join", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: Language identification and tokenisation have no SQL form; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
