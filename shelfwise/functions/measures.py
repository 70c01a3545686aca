"""Money and ratio expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Traffic-light symbols of the reorder report, and the symbol
# for any other status.
STATUS_FLAGS = {"red": "🔴", "yellow": "🟡", "green": "🟢"}
UNKNOWN_FLAG = "⚪"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def safe_div(num: str | Column, den: str | Column) -> Column:
    """Division that yields null on a zero divisor (ANSI mode would raise)."""
    return F.try_divide(_c(num), _c(den))


def as_double(col: str | Column) -> Column:
    """Money leaves the exact (decimal) domain only at the end of an operator."""
    return _c(col).cast("double")


def money_sum(col: str | Column) -> Column:
    """G1 with the empty-input rule: a sum over no rows is 0, not null."""
    return F.coalesce(F.sum(_c(col)), F.lit(0))


def padded_id(prefix: str, n: str | Column, width: int) -> Column:
    """``prefix`` + zero-padded number; never truncates (``lpad`` alone
    would cut a longer number). Numbers in [0, 10^width) take the cheap
    ``lpad`` path; others go through ``format_string``."""
    n = _c(n)
    return F.when(
        (n >= F.lit(0)) & (n < F.lit(10**width)),
        F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0")),
    ).otherwise(F.format_string(f"{prefix}%0{width}d", n))


def order_key(df) -> Column:
    """The column to count distinct orders on: the integer ``invoice_no``
    when the frame carries one (an adapter guarantees invoice_id is an
    injective format of it), else ``invoice_id``. Counting distinct longs
    hashes and shuffles 8 bytes per key instead of a string."""
    return F.col("invoice_no") if "invoice_no" in df.columns else F.col("invoice_id")


def margin_pct(profit: str | Column, revenue: str | Column) -> Column:
    """Profit ÷ revenue × 100, null when revenue is 0."""
    return safe_div(_c(profit), _c(revenue)) * F.lit(100.0)


def status_flag(status: str | Column) -> Column:
    """Status → symbol through a literal map, default for anything else."""
    pairs = []
    for k, v in STATUS_FLAGS.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.coalesce(F.create_map(*pairs)[_c(status)], F.lit(UNKNOWN_FLAG))


def line_measures(
    df,
    unit_price: str = "unit_price",
    quantity: str = "quantity",
    discount: str = "discount_pct",
    margin: str = "margin_pct",
):
    """Add ``net_revenue`` and ``profit`` from price, quantity, discount, margin.

    gross = price × qty; net = gross × (1 − discount); profit = net × margin.
    """
    net = _c(unit_price) * _c(quantity) * (F.lit(1) - _c(discount))
    return df.withColumn("net_revenue", net).withColumn(
        "profit", F.col("net_revenue") * _c(margin)
    )


def distinct_count(col: str | Column, rsd: float | None = None) -> Column:
    """Exact ``count(DISTINCT …)``, or with ``rsd`` the HyperLogLog++
    estimate (relative standard deviation ``rsd``), which needs no
    (key, value) pre-aggregation shuffle — the opt-in for very large inputs.
    Both skip nulls."""
    c = _c(col)
    return F.approx_count_distinct(c, rsd) if rsd else F.count_distinct(c)
