"""A key holding a third of all rows: results stay whole and exact."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import cohort as C
from shelfwise.operators import forecast as FC
from shelfwise.operators import rfm as R
from shelfwise.sources import tpch
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def skewed(spark):
    tx = tpch.transactions(spark, SF_SMALL)
    n = tx.count()
    # Re-key half of the rows to one hot customer and one hot product:
    # together with its own rows the hot key holds over a third of all rows.
    hot = F.xxhash64("invoice_id", "product_id", "quantity") % 2 == 0
    out = tx.withColumn("customer_id", F.when(hot, F.lit(7)).otherwise(F.col("customer_id"))) \
            .withColumn("product_id", F.when(hot, F.lit(11)).otherwise(F.col("product_id"))) \
            .repartition(6).cache()
    assert out.filter("customer_id = 7").count() >= n / 3
    return out


def test_customer_base_under_skew(skewed):
    got = R.customer_base(skewed).toPandas().set_index("customer_id").sort_index()
    pdf = skewed.select("customer_id", "invoice_no", F.col("net_revenue").cast("double").alias("m"),
                        "purchase_date").toPandas()
    want = pdf.groupby("customer_id").agg(frequency=("invoice_no", "nunique"),
                                          first_purchase=("purchase_date", "min"),
                                          last_purchase=("purchase_date", "max"))
    assert (got.frequency == want.frequency).all()
    assert (got.first_purchase == want.first_purchase).all()
    assert (got.last_purchase == want.last_purchase).all()
    assert abs(got.monetary.sum() - pdf.m.sum()) < 1e-6 * pdf.m.sum()


def test_cohort_sizes_under_skew(skewed):
    m = C.monthly_cohort_matrix(skewed).filter("months_since = 0").toPandas()
    first = skewed.select("customer_id", "month_start").toPandas().groupby("customer_id").month_start.min()
    want = first.value_counts().sort_index()
    got = m.set_index("cohort_month").cohort_size.sort_index()
    assert list(got.index) == list(want.index) and list(got.values) == list(want.values)


def test_daily_series_of_hot_product(skewed):
    d = FC.daily_units(skewed).filter("product_id = 11").orderBy("ds").toPandas()
    raw = skewed.filter("product_id = 11").select("purchase_date", "quantity").toPandas()
    days = pd.date_range(raw.purchase_date.min(), raw.purchase_date.max(), freq="D").date
    assert list(d.ds) == list(days)
    assert d.y.sum() == raw.quantity.sum()
