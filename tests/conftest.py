"""Shared fixtures: one local session, builders for small canonical frames."""

from __future__ import annotations

import os
import sys
from datetime import date, datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfwise.session import checkpoint_dir, get_spark  # noqa: E402
from shelfwise.sources.tables import with_calendar  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"

TX_SCHEMA = (
    "invoice_id string, customer_id long, product_id long, purchase_ts timestamp_ntz, "
    "quantity int, unit_price double, discount_pct double, net_revenue double, profit double"
)
PRODUCTS_SCHEMA = (
    "product_id long, sku string, category string, unit_price double, margin_pct double, "
    "stock_on_hand long"
)
CUSTOMERS_SCHEMA = "customer_id long, signup_date date, country string"


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", app_name="shelfwise-tests", shuffle_partitions=8)
    checkpoint_dir(s)
    yield s


def ts(d: str, hour: int = 12) -> datetime:
    y, m, dd = map(int, d.split("-"))
    return datetime(y, m, dd, hour)


def d(s: str) -> date:
    y, m, dd = map(int, s.split("-"))
    return date(y, m, dd)


def sale(inv, cust, prod, day, qty=1, price=10.0, disc=0.0, margin=0.5, hour=12):
    net = price * qty * (1 - disc)
    return (inv, cust, prod, ts(day, hour), qty, price, disc, net, net * margin)


@pytest.fixture
def make_tx(spark):
    def build(rows):
        return with_calendar(spark.createDataFrame(rows, TX_SCHEMA))

    return build


@pytest.fixture
def make_products(spark):
    def build(rows):
        return spark.createDataFrame(rows, PRODUCTS_SCHEMA)

    return build


@pytest.fixture
def make_customers(spark):
    def build(rows):
        return spark.createDataFrame(rows, CUSTOMERS_SCHEMA)

    return build
