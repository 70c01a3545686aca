"""Corpus pipeline: documents through quality rules, near-duplicate removal,
benchmark decontamination, redaction of personal data and sequence packing.

Each stage takes what the one before it kept and returns the columns of
``documents``; the last returns one row for each packed piece. Stages make
their own decisions on their own input and drop nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import stage, table
from shelfwise.llm.decontaminate import clean_documents
from shelfwise.llm.minhash_dedup import keep_one_of_each
from shelfwise.llm.packing import pack_documents
from shelfwise.llm.pii import redact
from shelfwise.llm.quality_rules import (
    kept_documents,
    labelled_documents,
    learn_rules,
    with_statistics,
)
from shelfwise.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned list rejects."""
    labels = table(spark, sf_dir, "labels")
    statistics = with_statistics(labelled_documents(docs, labels), ["doc_id"])
    return kept_documents(docs, learn_rules(statistics, labels))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is alike at 0.8 or more."""
    return keep_one_of_each(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage, literal or with other values."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_dedup", minhash_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

# Learned rules, MinHash and packing have no SQL; tests hold each operator against
# a brute-force version and the stages against planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each but the last written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
