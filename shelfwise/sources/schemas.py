"""Canonical schemas of the three retail tables and a schema check (Q5).

Files carry their schema in the Parquet footer; these StructTypes say what the
operators need. The check compares *type families* (an integral column may be
int or bigint, money may be float, double or decimal), so exact decimal money
from an adapter and float32 money from another writer both pass.
"""

from __future__ import annotations

from pyspark.sql import types as T

TRANSACTIONS_SCHEMA = T.StructType(
    [
        T.StructField("invoice_id", T.StringType()),
        T.StructField("customer_id", T.LongType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("purchase_ts", T.TimestampNTZType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("unit_price", T.DoubleType()),
        T.StructField("discount_pct", T.DoubleType()),
        T.StructField("net_revenue", T.DoubleType()),
        T.StructField("profit", T.DoubleType()),
    ]
)

CUSTOMERS_SCHEMA = T.StructType(
    [
        T.StructField("customer_id", T.LongType()),
        T.StructField("signup_date", T.DateType()),
        T.StructField("country", T.StringType()),
    ]
)

PRODUCTS_SCHEMA = T.StructType(
    [
        T.StructField("product_id", T.LongType()),
        T.StructField("sku", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("unit_price", T.DoubleType()),
        T.StructField("margin_pct", T.DoubleType()),
        T.StructField("stock_on_hand", T.LongType()),
    ]
)

SCHEMAS = {
    "transactions": TRANSACTIONS_SCHEMA,
    "customers": CUSTOMERS_SCHEMA,
    "products": PRODUCTS_SCHEMA,
}


def type_family(dt: T.DataType) -> str:
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integral"
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "fractional"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(dt, T.DateType):
        return "date"
    if isinstance(dt, T.StringType):
        return "string"
    return dt.simpleString()


def schema_problems(actual: T.StructType, expected: T.StructType) -> list[str]:
    """Missing or mistyped columns, as readable messages (empty = fine)."""
    have = {f.name: f.dataType for f in actual.fields}
    problems = []
    for f in expected.fields:
        if f.name not in have:
            problems.append(f"missing column {f.name!r}")
            continue
        want, got = type_family(f.dataType), type_family(have[f.name])
        # An integral column is acceptable where a fractional one is expected.
        if want != got and not (want == "fractional" and got == "integral"):
            problems.append(
                f"column {f.name!r} is {have[f.name].simpleString()}, expected {want}"
            )
    return problems


def check_schema(df, expected: T.StructType, name: str = "table") -> None:
    """Raise ``ValueError`` naming every missing or mistyped column."""
    problems = schema_problems(df.schema, expected)
    if problems:
        raise ValueError(f"{name}: " + "; ".join(problems))
