"""A corpus pipeline over ``documents``: each stage works on all that the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalumen.llm import decontaminate, language_id, near_dup, packing, secret_scan
from catalumen.llm.base import table, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; those without letters go."""
    return language_id.keep_known(docs, language_id.fold_model(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return near_dup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def cut_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark and ``n_chars`` counted anew."""
    return secret_scan.redact(docs, "text", "n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 ids."""
    return packing.pack_documents(docs, packing.vocabulary())


STAGES = [
    ("language_id", known_language),
    ("near_dup", one_of_each),
    ("decontamination", without_benchmark),
    ("secret_scan", cut_secrets),
    ("packing", pack),
]

# Stages learn models, verify by edit distance and pack by a search; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
