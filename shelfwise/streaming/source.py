"""File-stream source for transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfwise.sources.schemas import TRANSACTIONS_SCHEMA
from shelfwise.sources.tables import with_calendar


def stream_transactions(
    spark: SparkSession, folder: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Streaming DataFrame over new Parquet files in ``folder``: the
    canonical transaction schema (streams need it up front) plus calendar
    columns."""
    reader = spark.readStream.schema(TRANSACTIONS_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return with_calendar(reader.parquet(folder))
