"""Files in the reference's own layout (float32 money, int32 quantity,
nanosecond timestamps) go through the loaders into the operators."""

from __future__ import annotations

import os
import tempfile
from datetime import date

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from shelfwise.operators import cohort as C
from shelfwise.operators import descriptive as D
from shelfwise.operators import prescriptive as X
from shelfwise.operators import quality as Q
from shelfwise.operators import rfm as R
from shelfwise.sources import enrich, load_customers, load_products, load_transactions


@pytest.fixture(scope="module")
def files():
    rng = np.random.default_rng(11)
    folder = tempfile.mkdtemp(prefix="refmt-")
    n_c, n_p, n = 40, 12, 600
    pq.write_table(pa.table({
        "customer_id": pa.array(np.arange(1, n_c + 1), pa.int64()),
        "signup_date": pa.array([date(2023, 1, 1)] * n_c, pa.date32()),
        "country": pa.array([["DE", "FR", "US"][i % 3] for i in range(n_c)]),
        "propensity": pa.array(rng.random(n_c).astype(np.float32)),
    }), os.path.join(folder, "customers.parquet"))
    pq.write_table(pa.table({
        "product_id": pa.array(np.arange(1, n_p + 1), pa.int64()),
        "sku": [f"SKU-{i:06d}" for i in range(1, n_p + 1)],
        "category": [["Toys", "Food"][i % 2] for i in range(n_p)],
        "unit_price": rng.uniform(1.5, 99.0, n_p),
        "margin_pct": rng.uniform(0.05, 0.75, n_p),
        "stock_on_hand": pa.array(rng.integers(5, 2000, n_p), pa.int64()),
    }), os.path.join(folder, "products.parquet"))
    days = rng.integers(0, 365, n)
    ts = (np.datetime64("2023-01-01") + days.astype("timedelta64[D]")).astype("datetime64[ns]")
    ts = ts + rng.integers(0, 24, n).astype("timedelta64[h]")
    qty = rng.integers(1, 4, n).astype(np.int32)
    price = rng.uniform(1.5, 99.0, n).astype(np.float32)
    net = (price * qty).astype(np.float32)
    cust = rng.integers(1, n_c + 1, n)
    pq.write_table(pa.table({
        "invoice_id": [f"INV-{c * 1000 + d:08d}" for c, d in zip(cust, days)],
        "customer_id": pa.array(cust, pa.int64()),
        "product_id": pa.array(rng.integers(1, n_p + 1, n), pa.int64()),
        "purchase_ts": pa.array(ts.astype(np.int64), pa.timestamp("ns")),
        "quantity": pa.array(qty, pa.int32()),
        "unit_price": pa.array(price, pa.float32()),
        "discount_pct": pa.array(np.zeros(n, np.float32)),
        "net_revenue": pa.array(net, pa.float32()),
        "profit": pa.array((net * 0.3).astype(np.float32)),
    }), os.path.join(folder, "transactions.parquet"))
    return folder, n


def test_operators_on_reference_layout(spark, files):
    folder, n = files
    tx = load_transactions(spark, os.path.join(folder, "transactions.parquet"),
                           nanos_timestamps=True)
    prod = load_products(spark, os.path.join(folder, "products.parquet"))
    cust = load_customers(spark, os.path.join(folder, "customers.parquet"))
    s = D.dataset_summary(tx).first()
    assert s.rows == n and s.gross_revenue > 0 and s.first_day >= date(2023, 1, 1)
    cats = D.revenue_by_category(enrich(tx, products=prod)).collect()
    assert abs(sum(r.revenue_share for r in cats) - 1) < 1e-9
    rfm = R.compute_rfm(tx)
    assert rfm.count() == tx.select("customer_id").distinct().count()
    assert R.tier_summary(rfm).count() >= 1
    m = C.monthly_cohort_matrix(tx).filter("months_since = 0").collect()
    assert {r.retention for r in m} == {1.0}
    dead = X.dead_stock(tx, prod, lookback_days=30, min_stock_value=0.0)
    assert "parked_value" in dead.columns
    o = Q.orphans(tx, cust, prod).first()
    assert o.orphan_customers == 0 and o.orphan_products == 0
    assert Q.pre_signup(tx, cust).first().pre_signup_rows == 0
