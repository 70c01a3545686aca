"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.session import checkpoint_dir

# The ASCII white space that separates words in every contract.
WHITE_SPACE = " \t\n\x0b\f\r"
WHITE_SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Rows that are worth a task of their own, and the tasks that small tables get.
TASK_ROWS = 50_000
LEAST_TASKS = 16


def stage(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and reread it.

    Cuts the lineage in a way that outlives any executor: the files lie where
    ``spark.checkpoint.dir`` says, which every executor and the driver share.
    ``rows``, where a bound is known, keeps a small table from being worked out
    and written by as many tasks as the session has shuffle partitions; the
    tasks grow with it, so a large table has them all.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm/{label}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(LEAST_TASKS + rows // TASK_ROWS)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row.

    A lambda variable is the only name Catalyst never replaces by the
    expression behind it, so ``body`` may use it inside other lambdas without
    the value being computed again for each of their elements.
    """
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, WHITE_SPACE_RUN, -1)
    )


def held_out(doc_id: Column) -> Column:
    """True for the documents no model may learn from: crc32(id as text) mod 3 = 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
