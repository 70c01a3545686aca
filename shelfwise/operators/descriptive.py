"""KPI summary and descriptive breakdowns.

Sums of money are taken in the input's own type (exact when it is DECIMAL)
and cast to double only in the final projection. Every group-by is planned as
partial + final HashAggregate, so a hot key (one category holding a third of
the rows) is pre-aggregated on the map side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.calendar import bucket
from shelfwise.functions.measures import (
    as_double,
    distinct_count,
    margin_pct,
    money_sum,
    order_key,
    safe_div,
)


def dataset_summary(df: DataFrame, approx_rsd: float | None = None) -> DataFrame:
    """K1: one row — rows, customers, products, orders, gross_revenue (Σ net
    revenue), gross_profit, first_day, last_day.

    Three exact distinct counts in one aggregate are planned by Catalyst as an
    ``Expand`` (one copy of each row per distinct column) feeding a two-level
    aggregate; the copies are pre-aggregated per partition before the shuffle.
    ``approx_rsd`` switches the three counts to HyperLogLog++ (no Expand).
    """
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        distinct_count("customer_id", approx_rsd).alias("customers"),
        distinct_count("product_id", approx_rsd).alias("products"),
        distinct_count(order_key(df), approx_rsd).alias("orders"),
        as_double(money_sum("net_revenue")).alias("gross_revenue"),
        as_double(money_sum("profit")).alias("gross_profit"),
        F.min("purchase_date").alias("first_day"),
        F.max("purchase_date").alias("last_day"),
    )


def summary_margin(summary: DataFrame) -> DataFrame:
    """E19 on the KPI row: gross_profit ÷ gross_revenue × 100 (null when there
    is no revenue)."""
    return summary.withColumn("margin_pct", margin_pct("gross_profit", "gross_revenue"))


def preview(df: DataFrame, n: int, *order, last: bool = False) -> DataFrame:
    """The first n rows in the given order, or with ``last`` the last n
    (reversed order + limit, then back in the given order). Plans as a
    per-partition top-n."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    if not last:
        return df.orderBy(*cols).limit(n)
    rev = [c.desc_nulls_last() for c in cols]
    return df.orderBy(*rev).limit(n).orderBy(*cols)


def _buckets(df: DataFrame, grain: str, approx_rsd: float | None = None) -> DataFrame:
    """Per-bucket sums, money still in the input type (``revenue_x``)."""
    return (
        df.withColumn("bucket", bucket("purchase_ts", grain))
        .groupBy("bucket")
        .agg(
            money_sum("net_revenue").alias("revenue_x"),
            money_sum("profit").alias("profit_x"),
            distinct_count(order_key(df), approx_rsd).alias("orders"),
            distinct_count("customer_id", approx_rsd).alias("customers"),
            money_sum("quantity").cast("long").alias("units"),
        )
    )


def revenue_over_time(
    df: DataFrame, grain: str = "day", approx_rsd: float | None = None
) -> DataFrame:
    """Bucket, revenue, profit, orders, customers, units — sorted by bucket,
    only buckets that had sales."""
    return (
        _buckets(df, grain, approx_rsd)
        .select(
            "bucket",
            as_double("revenue_x").alias("revenue"),
            as_double("profit_x").alias("profit"),
            "orders",
            "customers",
            "units",
        )
        .orderBy("bucket")
    )


def rolling_revenue(df: DataFrame, window_days: int = 7, grain: str = "day") -> DataFrame:
    """D1 plus ``revenue_ma_{n}``, the mean over the current and previous
    n−1 *buckets* (rows, not calendar days), defined from the first bucket on.

    The window has no partition key, so it runs in one task — but only over
    the aggregated series, one row per bucket, whose size is bounded by the
    calendar, not by the data volume.
    """
    if window_days < 1:
        raise ValueError("window_days must be >= 1")
    w = Window.orderBy("bucket").rowsBetween(-(window_days - 1), 0)
    ma = as_double(F.sum("revenue_x").over(w)) / F.count(F.lit(1)).over(w)
    return (
        _buckets(df, grain)
        .select(
            "bucket",
            as_double("revenue_x").alias("revenue"),
            as_double("profit_x").alias("profit"),
            "orders",
            "customers",
            "units",
            ma.alias(f"revenue_ma_{window_days}"),
        )
        .orderBy("bucket")
    )


def revenue_by_category(df: DataFrame, approx_rsd: float | None = None) -> DataFrame:
    """D3: category, revenue, profit, units, orders, revenue_share,
    profit_margin — revenue descending.

    The share's denominator is a window over the grouped result (one row per
    category), never over the fact rows.
    """
    g = df.groupBy("category").agg(
        money_sum("net_revenue").alias("revenue_x"),
        money_sum("profit").alias("profit_x"),
        money_sum("quantity").cast("long").alias("units"),
        distinct_count(order_key(df), approx_rsd).alias("orders"),
    )
    total = F.sum("revenue_x").over(Window.partitionBy())
    return g.select(
        "category",
        as_double("revenue_x").alias("revenue"),
        as_double("profit_x").alias("profit"),
        "units",
        "orders",
        safe_div(as_double("revenue_x"), as_double(total)).alias("revenue_share"),
        safe_div(as_double("profit_x"), as_double("revenue_x")).alias("profit_margin"),
    ).orderBy(F.desc_nulls_first("revenue"), F.asc_nulls_first("category"))


def revenue_by_country(
    df: DataFrame, customers: DataFrame | None = None, approx_rsd: float | None = None
) -> DataFrame:
    """Country, revenue, profit, customers — revenue descending.

    With ``customers`` (one row per customer_id), ``df`` is the bare
    transactions: they are summed per customer first, partial sums before the
    shuffle, so a customer with a third of the rows is one row by the time the
    dimension is joined, and counting customers needs no distinct count.
    Without it, ``df`` carries ``country`` already.
    """
    if customers is None:
        sums, n = df, distinct_count("customer_id", approx_rsd)
    else:
        per = df.groupBy("customer_id").agg(
            money_sum("net_revenue").alias("net_revenue"), money_sum("profit").alias("profit")
        )
        sums = per.join(customers.select("customer_id", "country"), "customer_id", "left")
        n = F.count("customer_id")
    return (
        sums.groupBy("country")
        .agg(
            as_double(money_sum("net_revenue")).alias("revenue"),
            as_double(money_sum("profit")).alias("profit"),
            n.alias("customers"),
        )
        .orderBy(F.desc_nulls_first("revenue"), F.asc_nulls_first("country"))
    )


def weekday_hour_heatmap(df: DataFrame) -> DataFrame:
    """Weekday (1=Mon), hour, revenue, transactions (rows, not orders)."""
    return (
        df.groupBy("weekday", "hour")
        .agg(
            as_double(money_sum("net_revenue")).alias("revenue"),
            F.count(F.lit(1)).alias("transactions"),
        )
        .orderBy("weekday", "hour")
    )


def top_products(df: DataFrame, n: int = 20, products: DataFrame | None = None) -> DataFrame:
    """The n products with most revenue (ties broken by product_id).

    ``orderBy + limit`` plans as ``TakeOrderedAndProject``: each partition
    keeps its own top n, so only n rows per partition reach the final task.
    With ``products``, ``df`` is the bare transactions: they are summed per
    product first and only the n rows are joined with the dimension.
    """
    labels = ["sku", "category"]
    keys = ["product_id"] if products is not None else ["product_id", *labels]
    order = [F.desc_nulls_first("revenue"), F.asc("product_id")]
    top = (
        df.groupBy(*keys)
        .agg(
            as_double(money_sum("net_revenue")).alias("revenue"),
            as_double(money_sum("profit")).alias("profit"),
            money_sum("quantity").cast("long").alias("units"),
        )
        .orderBy(*order)
        .limit(n)
    )
    if products is not None:
        top = top.join(products.select("product_id", *labels), "product_id", "left").orderBy(*order)
    return top.select("product_id", *labels, "revenue", "profit", "units")


def category_join_rollup(
    tx: DataFrame, products: DataFrame, approx_rsd: float | None = None
) -> DataFrame:
    """Inner join transactions × products, then per category: rev,
    profit, orders — rev descending."""
    key = order_key(tx)
    return (
        tx.select("product_id", "net_revenue", "profit", key)
        .join(products.select("product_id", "category"), "product_id", "inner")
        .groupBy("category")
        .agg(
            as_double(money_sum("net_revenue")).alias("rev"),
            as_double(money_sum("profit")).alias("profit"),
            distinct_count(key, approx_rsd).alias("orders"),
        )
        .orderBy(F.desc_nulls_first("rev"), F.asc_nulls_first("category"))
    )
