"""Registered corpus queries (``opN_<name>``) and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import held_out, table
from shelfwise.llm.compression_quality import learn, score_quality
from shelfwise.llm.conversations import damage, repair_conversations
from shelfwise.llm.decontaminate import contamination_report
from shelfwise.llm.decontaminate import oracle_sql as decontamination_sql
from shelfwise.llm.divergence import audit_sources
from shelfwise.llm.divergence import oracle_sql as divergence_sql
from shelfwise.llm.fingerprints import edits_by_next
from shelfwise.llm.language_id import identify, learn_profiles
from shelfwise.llm.minhash_dedup import near_duplicates
from shelfwise.llm.minhash_dedup import oracle_sql as dedup_sql
from shelfwise.llm.packing import pack_documents
from shelfwise.llm.pii import KINDS, personal_data, span_text
from shelfwise.llm.quality_rules import quality_report
from shelfwise.llm.sharding import assign_shards, grown, tree
from shelfwise.llm.token_counts import count_tokens
from shelfwise.llm.url_graph import ALLOW, BLOCK, judge_urls
from shelfwise.llm.url_graph import oracle_sql as url_sql

# The rules of the url contract.
URL_RULES = [
    (ALLOW, "com/"),
    (BLOCK, "example.com/en/"),
    (ALLOW, "www.example.com/en/"),
    (BLOCK, "net/es/"),
    (BLOCK, "net/fr/"),
]
SHARDS = 40


def tokenizer_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn_profiles(docs))
    return found.withColumn("held_out", held_out(F.col("doc_id")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


def op4_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES).drop("trust", "distrust")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "rule",
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = {k: k for k in KINDS}
    return personal_data(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"),
        span_text(base | {"id": "added"}).alias("spans"),
    )


def op7_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score_quality(docs, learn(docs, table(spark, sf_dir, "labels")))
    return found.withColumns(
        {
            "held_out": held_out(F.col("doc_id")),
            "predicted": F.when(F.col("score") >= 0.5, 1).otherwise(0),
        }
    )


def op8_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = tree(SHARDS)
    return assign_shards(
        table(spark, sf_dir, "documents"), root, grown(root, SHARDS)
    ).withColumn("law", F.lit("key"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damage(table(spark, sf_dir, "conversations")))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits_by_next(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_language_id": op2_language_id,
    "op3_decontamination": op3_decontamination,
    "op4_url_graph": op4_url_graph,
    "op5_quality_rules": op5_quality_rules,
    "op6_pii": op6_pii,
    "op7_compression_quality": op7_compression_quality,
    "op8_hash_tree": op8_hash_tree,
    "op9_packing": op9_packing,
    "op10_token_counts": op10_token_counts,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_source_divergence": op12_source_divergence,
    "op13_fingerprints": op13_fingerprints,
}

ORACLE = {
    "op1_minhash_dedup": dedup_sql(85),
    "op3_decontamination": decontamination_sql(),
    "op4_url_graph": url_sql(URL_RULES),
    "op12_source_divergence": divergence_sql(),
}
