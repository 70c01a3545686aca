"""Adapter from TPC-H-style tables to the retail model.

The test tables are a star schema (lineitem, orders, customer, nation, part,
events). This module maps them onto the three retail tables the operators
expect:

=================  ==========================================================
transactions       lineitem ⋈ orders on the order key; one row per line
  invoice_id       'INV-%08d' of the order key
  invoice_no       the order key itself (distinct counts use it)
  customer_id      o_custkey
  product_id       l_partkey
  purchase_ts      o_orderdate (the order date, not the ship date)
  quantity         l_quantity as int
  unit_price       l_extendedprice / l_quantity
  discount_pct     l_discount
  net_revenue      extended price × (1 − discount), DECIMAL (exact sums)
  profit           net_revenue × margin, DECIMAL
customers          customer ⋈ nation (25 rows, broadcast): country = n_name;
                   signup_date is not in the source: a stand-in derived
                   from the key, so that some orders precede it
products           part: sku 'SKU-%06d', category = p_type, unit_price =
                   p_retailprice, margin and stock derived from the key
=================  ==========================================================

Margin and stock are stand-ins computed from the product key alone, so the
fact table needs no join with ``part`` to price its profit: the only join in
the fact is lineitem ⋈ orders.

Money is kept DECIMAL until an operator's final projection casts it to
double, so sums are exact and independent of the order rows are added in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.measures import padded_id
from shelfwise.session import default_parallelism
from shelfwise.sources.schemas import CUSTOMERS_SCHEMA, PRODUCTS_SCHEMA, TRANSACTIONS_SCHEMA
from shelfwise.sources.tables import check_schema, with_calendar

# Fixed values of the stand-in product attributes (ranges follow the retail
# generator: margin 5–75 %, stock 5–1999 units).
MARGIN_MIN_PCT = 5
MARGIN_SPAN = 71
MARGIN_MULT = 37
STOCK_MIN = 5
STOCK_SPAN = 1995
STOCK_MULT = 7919
SIGNUP_FROM = "1994-01-01"
SIGNUP_SPAN = 1500
SIGNUP_MULT = 131
LINES_A_TASK = 1_000_000  # where memory goes by the orders of a task


def margin_pct_points(product_id) -> F.Column:
    """Integer margin percent in [5, 75] derived from the product key."""
    return F.lit(MARGIN_MIN_PCT) + (product_id * F.lit(MARGIN_MULT)) % F.lit(MARGIN_SPAN)


def stock_on_hand(product_id) -> F.Column:
    return (F.lit(STOCK_MIN) + (product_id * F.lit(STOCK_MULT)) % F.lit(STOCK_SPAN)).cast("long")


def signup_date(customer_id) -> F.Column:
    days = (customer_id * F.lit(SIGNUP_MULT)) % F.lit(SIGNUP_SPAN)
    return F.date_add(F.lit(SIGNUP_FROM).cast("date"), days.cast("int"))


@dataclass(frozen=True)
class RetailTables:
    transactions: DataFrame
    customers: DataFrame
    products: DataFrame


def _path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def _by_order(li: DataFrame) -> DataFrame:
    """The lines dealt by order to tasks of about ``LINES_A_TASK``; left to AQE
    where it makes as many tasks anyway. The count reads file footers only."""
    tasks = -(-li.count() // LINES_A_TASK)
    return li.repartition(tasks, "l_orderkey") if tasks > default_parallelism(li.sparkSession) else li


def transactions(spark: SparkSession, sf_dir: str, by_order: bool = False) -> DataFrame:
    """The fact table. With ``by_order``, for queries that count distinct orders of
    a key: they hold each (key, order) of a task in memory, in the tasks of the join,
    and AQE would merge those by bytes of compressed lines, some 3 M a task."""
    li = spark.read.parquet(_path(sf_dir, "lineitem")).select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount"
    )
    if by_order:
        li = _by_order(li)
    orders = spark.read.parquet(_path(sf_dir, "orders")).select(
        "o_orderkey", "o_custkey", "o_orderdate"
    )
    net = F.col("l_extendedprice").cast("decimal(18,2)") * (
        F.lit(1) - F.col("l_discount").cast("decimal(4,2)")
    )
    margin = (margin_pct_points(F.col("l_partkey")) * F.lit(0.01)).cast("decimal(4,2)")
    # Both sides grow with the data: Spark picks sort-merge at scale and, by
    # size, a broadcast of the orders where a filter or a small table allows.
    tx = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "inner").select(
        padded_id("INV-", "l_orderkey", 8).alias("invoice_id"),
        F.col("l_orderkey").alias("invoice_no"),
        F.col("o_custkey").alias("customer_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("purchase_ts"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("unit_price"),
        F.col("l_discount").alias("discount_pct"),
        net.alias("net_revenue"),
        (net * margin).alias("profit"),
    )
    check_schema(tx, TRANSACTIONS_SCHEMA, "transactions")
    return with_calendar(tx)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = spark.read.parquet(_path(sf_dir, "customer")).select("c_custkey", "c_nationkey")
    # nation is a fixed 25-row dimension: a broadcast with a proven size bound.
    nation = spark.read.parquet(_path(sf_dir, "nation")).select("n_nationkey", "n_name")
    out = cust.join(
        F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left"
    ).select(
        F.col("c_custkey").alias("customer_id"),
        signup_date(F.col("c_custkey")).alias("signup_date"),
        F.col("n_name").alias("country"),
    )
    check_schema(out, CUSTOMERS_SCHEMA, "customers")
    return out


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(_path(sf_dir, "part")).select(
        "p_partkey", "p_type", "p_retailprice"
    )
    out = part.select(
        F.col("p_partkey").alias("product_id"),
        padded_id("SKU-", "p_partkey", 6).alias("sku"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("unit_price"),
        (margin_pct_points(F.col("p_partkey")) / F.lit(100.0)).alias("margin_pct"),
        stock_on_hand(F.col("p_partkey")).alias("stock_on_hand"),
    )
    check_schema(out, PRODUCTS_SCHEMA, "products")
    return out


def retail_tables(spark: SparkSession, sf_dir: str, by_order: bool = False) -> RetailTables:
    return RetailTables(
        transactions(spark, sf_dir, by_order), customers(spark, sf_dir), products(spark, sf_dir)
    )


def events_as_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` stream as timestamped sales: ts → purchase_ts, value →
    net_revenue (DECIMAL), user → customer. Order dates carry no time of day,
    so the weekday × hour view runs on these."""
    ev = spark.read.parquet(_path(sf_dir, "events")).select("event_id", "ts", "user_id", "value")
    return with_calendar(
        ev.select(
            padded_id("EVT-", "event_id", 8).alias("invoice_id"),
            F.col("user_id").alias("customer_id"),
            F.col("ts").cast("timestamp_ntz").alias("purchase_ts"),
            F.col("value").cast("decimal(18,2)").alias("net_revenue"),
        )
    )
