"""Data-quality checks and invoice ids."""

from __future__ import annotations

from shelfwise.functions.measures import padded_id
from shelfwise.operators import invoices as I
from shelfwise.operators import quality as Q
from tests.conftest import d, sale


def test_orphans_and_pre_signup(make_tx, make_products, make_customers):
    tx = make_tx([sale("A", 1, 1, "2023-01-05"), sale("B", 2, 9, "2023-01-05"),
                  sale("C", 7, 1, "2023-01-05")])
    cust = make_customers([(1, d("2023-01-01"), "FR"), (2, d("2023-01-06"), "DE")])
    prod = make_products([(1, "S1", "A", 1.0, 0.3, 5)])
    o = Q.orphans(tx, cust, prod).first()
    assert o.orphan_customers == 1 and o.orphan_products == 1
    assert Q.pre_signup(tx, cust).first().pre_signup_rows == 1


def test_positive_and_bounds(make_tx):
    tx = make_tx([sale("A", 1, 1, "2023-01-05"), sale("B", 1, 1, "2023-01-05", qty=0)])
    p = Q.positive_measures(tx).first()
    assert p.quantity_below_one == 1 and p.non_positive_revenue == 1 and p.min_quantity == 0
    b = Q.row_bounds(tx, 1, 1).first()
    assert b.rows == 2 and b.within_bounds is False


def test_duplicate_keys(make_products):
    prod = make_products([(1, "S1", "A", 1.0, 0.3, 5), (1, "S1b", "A", 1.0, 0.3, 5),
                          (2, "S2", "A", 1.0, 0.3, 5)])
    r = Q.duplicate_keys(prod, "product_id", "products").first()
    assert (r.rows, r.distinct_keys, r.duplicated_keys) == (3, 2, 1)


def test_invoice_ids_dense_rank(make_tx):
    tx = make_tx([sale("x", 2, 1, "2023-01-02"), sale("x", 1, 1, "2023-01-03"),
                  sale("x", 1, 2, "2023-01-03"), sale("x", 1, 1, "2023-01-01")])
    out = I.assign_invoice_ids(tx).select("customer_id", "purchase_date", "invoice_id").collect()
    ids = {(r.customer_id, str(r.purchase_date)): r.invoice_id for r in out}
    assert ids == {(1, "2023-01-01"): "INV-00000001", (1, "2023-01-03"): "INV-00000002",
                   (2, "2023-01-02"): "INV-00000003"}


def test_padded_id_never_truncates(spark):
    from pyspark.sql import functions as F

    r = spark.range(1).select(padded_id("INV-", F.lit(123456789), 8).alias("a"),
                              padded_id("INV-", F.lit(42), 8).alias("b"),
                              padded_id("INV-", F.lit(-5), 8).alias("c")).first()
    assert (r.a, r.b, r.c) == ("INV-123456789", "INV-00000042", "INV--0000005")


def test_line_measures(spark):
    df = spark.createDataFrame([(10.0, 3, 0.1, 0.5)],
                               "unit_price double, quantity int, discount_pct double, margin_pct double")
    r = I.line_measures(df).first()
    assert abs(r.net_revenue - 27.0) < 1e-12 and abs(r.profit - 13.5) < 1e-12
