"""Token counts through a digest cache (operator 10).

A text's count is stored under two digests: SHA-256 of its UTF-8 bytes and the
SHA-256 of the tokenizer file. Each call joins the documents' distinct digests
to the stored counts, encodes one text for each digest that is not stored,
appends those counts to the cache and joins the counts back to the documents.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); each input row
gives one output row, also repeated rows and rows with a null id; texts of any
length are encoded whole; an empty table gives an empty result; only the id
and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import stage
from shelfwise.llm.tokens import Encoder, tokenizer_digest
from shelfwise.session import checkpoint_dir, ship_package

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def read_cache(spark, cache_path: str) -> DataFrame:
    """The stored counts; a folder without a commit yet holds none."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)


def encode_counts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = Encoder.of(path)
    for batch in batches:
        counts = [len(encoder.ids(t.as_py())) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"]
        )


def _key(doc_id: Column, digest: Column) -> Column:
    """Id and digest in one; the digest's fixed length keeps pairs apart."""
    shown = F.coalesce(F.concat(F.lit("#"), doc_id.cast("string")), F.lit(""))
    return F.concat(shown.cast("binary"), digest)


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    cache_path: str | None = None,
    limit: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of every document.

    ``cache_path`` is a shared folder that keeps counts between calls; without
    it, a fresh one is made in the checkpoint folder. Work happens when called:
    the misses are encoded and appended before the result is returned. Counts
    stored twice by concurrent calls are equal and merged on reading.
    """
    spark = docs.sparkSession
    ship_package(spark)
    cache_path = cache_path or f"{checkpoint_dir(spark)}/llm/token-cache-{uuid.uuid4().hex}"
    version = tokenizer_digest(tokenizer_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        text.alias("text"),
    )
    rows = stage(keyed.drop("text"), "digests")

    stored = read_cache(spark, cache_path).filter(F.col("tokenizer") == version).select("digest")
    # Each missing digest is encoded once: the least id that has it stands for it,
    # and of rows that share that id and text, the first to arrive. Texts move
    # once, dealt by id and digest in one column, so a text that very many rows
    # share is spread over all partitions.
    missing = (
        rows.groupBy("digest")
        .agg(F.min("id").alias("rep"))
        .join(stored, "digest", "left_anti")
        .select("digest", _key(F.col("rep"), F.col("digest")).alias("key"))
    )
    texts = (
        keyed.select(_key(F.col("id"), F.col("digest")).alias("key"), "text")
        .groupBy("key")
        .agg(F.first("text").alias("text"))
        .join(missing, "key")
        .select("digest", "text")
    )
    (
        texts.mapInArrow(
            lambda it: encode_counts(it, tokenizer_path), "digest binary, n_tokens long"
        )
        .select(F.lit(version).alias("tokenizer"), "digest", "n_tokens")
        .write.mode("append")
        .parquet(cache_path)
    )
    # Staged, so that the join below stands on plain shuffles, which Spark can
    # split where very many rows share a text.
    counts = stage(
        read_cache(spark, cache_path)
        .filter(F.col("tokenizer") == version)
        .groupBy("digest")
        .agg(F.max("n_tokens").alias("n_tokens")),
        "counts",
    )
    return rows.join(counts, "digest").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
