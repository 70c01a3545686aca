"""Parquet loaders and the enriched star join.

All loaders are lazy: they return DataFrames whose plans Catalyst prunes to
the columns a query touches and pushes filters into (``PushedFilters`` in the
scan node).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.calendar import calendar_columns
from shelfwise.sources.schemas import (
    CUSTOMERS_SCHEMA,
    PRODUCTS_SCHEMA,
    TRANSACTIONS_SCHEMA,
    check_schema,
)

CUSTOMER_COLUMNS = ["customer_id", "signup_date", "country"]

# With no explicit path, tables are found under the folder named by this
# session setting, as <dir>/<table>.parquet.
DATA_DIR_CONF = "shelfwise.data.dir"


def table_path(spark: SparkSession, table: str, path: str | None = None) -> str:
    """The explicit path, else ``<shelfwise.data.dir>/<table>.parquet``."""
    if path is not None:
        return path
    base = spark.conf.get(DATA_DIR_CONF, None)
    if not base:
        raise ValueError(f"no path given for {table!r} and {DATA_DIR_CONF} is not set")
    return f"{base.rstrip('/')}/{table}.parquet"
PRODUCT_COLUMNS = ["product_id", "sku", "category", "margin_pct", "stock_on_hand"]


def _read(spark: SparkSession, path: str, nanos_columns: tuple[str, ...] = ()) -> DataFrame:
    if not nanos_columns:
        return spark.read.parquet(path)
    # Parquet TIMESTAMP(NANOS) is refused by Spark; read it as a long and
    # convert to microseconds.
    prev = spark.conf.get("spark.sql.legacy.parquet.nanosAsLong", "false")
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    try:
        df = spark.read.parquet(path)
        df = df.withColumns(
            {
                c: F.timestamp_micros(F.floor(F.col(c) / F.lit(1000)).cast("long")).cast(
                    "timestamp_ntz"
                )
                for c in nanos_columns
            }
        )
        df.schema  # resolve while the flag is set
        return df
    finally:
        spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", prev)


def with_calendar(df: DataFrame, ts: str = "purchase_ts") -> DataFrame:
    """Add purchase_date, year, month, weekday (1=Mon), hour, month_start."""
    return df.withColumns(calendar_columns(ts))


def _maybe_cache(df: DataFrame, cache: bool) -> DataFrame:
    """The eager read of the reference is a cached frame here."""
    return df.cache() if cache else df


def load_transactions(
    spark: SparkSession,
    path: str | None = None,
    nanos_timestamps: bool = False,
    cache: bool = False,
) -> DataFrame:
    """Lazy scan + schema check + six calendar columns."""
    df = _read(spark, table_path(spark, "transactions", path),
               ("purchase_ts",) if nanos_timestamps else ())
    check_schema(df, TRANSACTIONS_SCHEMA, "transactions")
    return _maybe_cache(with_calendar(df), cache)


def load_customers(spark: SparkSession, path: str | None = None, cache: bool = False) -> DataFrame:
    """S2."""
    df = _read(spark, table_path(spark, "customers", path))
    check_schema(df, CUSTOMERS_SCHEMA, "customers")
    return _maybe_cache(df, cache)


def load_products(spark: SparkSession, path: str | None = None, cache: bool = False) -> DataFrame:
    """S3."""
    df = _read(spark, table_path(spark, "products", path))
    check_schema(df, PRODUCTS_SCHEMA, "products")
    return _maybe_cache(df, cache)


def enrich(
    tx: DataFrame, customers: DataFrame | None = None, products: DataFrame | None = None
) -> DataFrame:
    """I0 restricted to the dimensions a query needs.

    Left joins, so fact rows survive with null dimension columns. Spark does
    not remove an unused N:1 left join, so operators that need no dimension
    column should be given the bare transactions instead. Join strategy is
    left to Spark: a dimension under the broadcast threshold (a size check
    done by the planner, again at run time by AQE) is broadcast, a larger one
    goes through a sort-merge join.
    """
    out = tx
    if customers is not None:
        out = out.join(customers.select(*CUSTOMER_COLUMNS), "customer_id", "left")
    if products is not None:
        out = out.join(products.select(*PRODUCT_COLUMNS), "product_id", "left")
    return out


def load_enriched(tx: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """Transactions + calendar + signup_date, country + sku, category,
    margin_pct, stock_on_hand. Product unit_price is not carried (the fact has
    its own line price)."""
    return enrich(tx, customers, products)
