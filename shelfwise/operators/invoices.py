"""Invoice ids and line measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.measures import line_measures, padded_id
from shelfwise.functions.ranking import with_dense_rank


def assign_invoice_ids(
    df: DataFrame, keys: tuple[str, ...] = ("customer_id", "purchase_date")
) -> DataFrame:
    """One invoice per distinct key (by default a customer's day):
    'INV-' + the key's dense rank zero-padded to 8 digits (longer numbers are
    kept whole). Rows with a null key get a null id."""
    ranked = with_dense_rank(df.drop("invoice_id", "invoice_no"), list(keys), "_inv_rank")
    return ranked.withColumn(
        "invoice_id",
        F.when(F.col("_inv_rank").isNotNull(), padded_id("INV-", "_inv_rank", 8)),
    ).drop("_inv_rank")


__all__ = ["assign_invoice_ids", "line_measures"]
