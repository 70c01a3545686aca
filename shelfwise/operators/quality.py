"""Data-quality checks as operators returning counts (Q1–Q6).

Each check returns a small DataFrame of violation counts rather than
asserting, so it runs on production data and its result can be stored or
alerted on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.sources.schemas import SCHEMAS, schema_problems, type_family


def orphans(tx: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """Q1: fact rows whose customer / product is missing from its dimension
    (anti joins; a null key counts as an orphan). The second count is a
    scalar subquery next to the first, not a join."""
    oc = tx.select("customer_id").join(
        customers.select("customer_id"), "customer_id", "left_anti"
    ).agg(F.count(F.lit(1)).alias("orphan_customers"))
    op = tx.select("product_id").join(
        products.select("product_id"), "product_id", "left_anti"
    ).agg(F.count(F.lit(1)).alias("orphan_products"))
    return oc.select("orphan_customers", op.scalar().alias("orphan_products"))


def pre_signup(tx: DataFrame, customers: DataFrame) -> DataFrame:
    """Q2: purchases dated before the customer's signup date."""
    return (
        tx.select("customer_id", "purchase_date")
        .join(customers.select("customer_id", "signup_date"), "customer_id", "inner")
        .agg(
            F.count(
                F.when(F.col("purchase_date") < F.col("signup_date"), F.lit(1))
            ).alias("pre_signup_rows")
        )
    )


def positive_measures(tx: DataFrame) -> DataFrame:
    """Q3: rows with net_revenue ≤ 0 or quantity < 1, and the minima."""
    return tx.agg(
        F.count(F.when(F.col("net_revenue") <= 0, F.lit(1))).alias("non_positive_revenue"),
        F.count(F.when(F.col("quantity") < 1, F.lit(1))).alias("quantity_below_one"),
        F.min("net_revenue").cast("double").alias("min_net_revenue"),
        F.min("quantity").alias("min_quantity"),
    )


def row_bounds(tx: DataFrame, lo: int, hi: int) -> DataFrame:
    """Q4: row count and whether it lies in [lo, hi]."""
    n = F.count(F.lit(1))
    return tx.agg(n.alias("rows")).select(
        "rows",
        F.lit(lo).cast("long").alias("lo"),
        F.lit(hi).cast("long").alias("hi"),
        ((F.col("rows") >= lo) & (F.col("rows") <= hi)).alias("within_bounds"),
    )


def row_bounds_near(tx: DataFrame, target: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """Q4 with a computed target: rows within ±tolerance of ``target``'s
    single ``target`` value (read as a scalar subquery)."""
    t = target.select(F.col("target").cast("long").alias("target")).scalar()
    got = tx.agg(F.count(F.lit(1)).alias("rows")).select("rows", t.alias("target"))
    lo = F.floor(F.col("target") * F.lit(1 - tolerance)).cast("long")
    hi = F.ceil(F.col("target") * F.lit(1 + tolerance)).cast("long")
    return got.select(
        "rows", "target", lo.alias("lo"), hi.alias("hi"),
        ((F.col("rows") >= lo) & (F.col("rows") <= hi)).alias("within_bounds"),
    )


def schema_report(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """Q5: one row per expected column of each named table: expected family,
    actual type (null if missing) and ok flag."""
    rows = []
    for name, df in frames.items():
        expected = SCHEMAS[name]
        have = {f.name: f.dataType for f in df.schema.fields}
        bad = {p.split("'")[1] for p in schema_problems(df.schema, expected)}
        for f in expected.fields:
            got = have.get(f.name)
            rows.append((name, f.name, type_family(f.dataType),
                         got.simpleString() if got is not None else None, f.name not in bad))
    return spark.createDataFrame(
        rows, "table string, column string, expected string, actual string, ok boolean"
    )


def duplicate_keys(df: DataFrame, key: str, table: str) -> DataFrame:
    """Q6: rows, distinct keys and keys occurring more than once."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.lit(table).alias("table"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"),
        F.count(F.col(key)).alias("distinct_keys"),
        F.count(F.when(F.col("n") > 1, F.lit(1))).alias("duplicated_keys"),
    )
