"""Descriptive breakdowns: the reference's invariants plus edge cases."""

from __future__ import annotations

from shelfwise.operators import descriptive as D
from shelfwise.sources import enrich
from shelfwise.sources import tpch
from tests.conftest import SF_SMALL, sale


def test_summary_keys_and_values(spark):
    s = D.dataset_summary(tpch.transactions(spark, SF_SMALL)).first().asDict()
    for k in ("rows", "customers", "products", "orders", "gross_revenue", "gross_profit",
              "first_day", "last_day"):
        assert k in s
    assert s["rows"] > 0 and s["gross_revenue"] > 0 and s["orders"] <= s["rows"]


def test_summary_of_empty_input(make_tx):
    s = D.dataset_summary(make_tx([])).first()
    assert s.rows == 0 and s.gross_revenue == 0.0 and s.first_day is None


def test_revenue_over_time_sorted_and_week_bucket(make_tx):
    tx = make_tx([sale("A", 1, 1, "2023-01-01"), sale("B", 2, 1, "2023-01-02"),
                  sale("C", 1, 1, "2023-01-09", qty=2)])
    day = D.revenue_over_time(tx, "day").collect()
    assert [str(r.bucket) for r in day] == ["2023-01-01", "2023-01-02", "2023-01-09"]
    week = D.revenue_over_time(tx, "week").collect()
    assert [str(r.bucket) for r in week] == ["2022-12-26", "2023-01-02", "2023-01-09"]
    assert week[2].units == 2 and week[1].orders == 1


def test_rolling_counts_rows_not_days(make_tx):
    # Days 1, 2 and 10: a 2-bucket window on day 10 averages days 2 and 10.
    tx = make_tx([sale("A", 1, 1, "2023-01-01", price=10.0),
                  sale("B", 1, 1, "2023-01-02", price=20.0),
                  sale("C", 1, 1, "2023-01-10", price=40.0)])
    r = D.rolling_revenue(tx, 2).collect()
    assert [x.revenue_ma_2 for x in r] == [10.0, 15.0, 30.0]
    assert "revenue_ma_7" in D.rolling_revenue(tx).columns


def test_category_sums_to_total_and_zero_revenue_margin(make_tx, make_products):
    tx = make_tx([sale("A", 1, 1, "2023-01-01", price=10.0), sale("B", 1, 2, "2023-01-01", price=30.0),
                  sale("C", 1, 3, "2023-01-01", price=0.0)])
    prod = make_products([(1, "S1", "Toys", 1.0, 0.5, 1), (2, "S2", "Food", 1.0, 0.5, 1),
                          (3, "S3", "Free", 1.0, 0.5, 1)])
    rows = D.revenue_by_category(enrich(tx, products=prod)).collect()
    assert abs(sum(r.revenue for r in rows) - 40.0) < 1e-9
    assert abs(sum(r.revenue_share for r in rows) - 1.0) < 1e-12
    assert rows[0].category == "Food"  # revenue descending
    free = [r for r in rows if r.category == "Free"][0]
    assert free.profit_margin is None  # 0 / 0 → null, not an error


def test_heatmap_ranges(spark):
    h = D.weekday_hour_heatmap(tpch.events_as_sales(spark, SF_SMALL)).collect()
    assert {r.weekday for r in h} <= set(range(1, 8))
    assert {r.hour for r in h} <= set(range(24))
    assert sum(r.transactions for r in h) == spark.read.parquet(f"{SF_SMALL}/events.parquet").count()


def test_top_products_bounded_and_sorted(spark):
    t = tpch.retail_tables(spark, SF_SMALL)
    top = D.top_products(enrich(t.transactions, products=t.products), 10).collect()
    assert len(top) <= 10
    revs = [r.revenue for r in top]
    assert revs == sorted(revs, reverse=True)


def test_category_join_rollup_is_inner(make_tx, make_products):
    tx = make_tx([sale("A", 1, 1, "2023-01-01"), sale("B", 1, 9, "2023-01-01")])
    prod = make_products([(1, "S1", "Toys", 1.0, 0.5, 1)])
    rows = D.category_join_rollup(tx, prod).collect()
    assert [(r.category, r.rev, r.orders) for r in rows] == [("Toys", 10.0, 1)]


def test_approximate_distinct_counts(spark):
    tx = tpch.transactions(spark, SF_SMALL)
    exact = D.dataset_summary(tx).first()
    approx = D.dataset_summary(tx, approx_rsd=0.02).first()
    for k in ("customers", "products", "orders"):
        assert abs(approx[k] - exact[k]) <= 0.08 * exact[k]
    assert approx.gross_revenue == exact.gross_revenue


def test_summary_margin_and_preview(make_tx):
    tx = make_tx([sale("A", 1, 1, f"2023-01-0{i}", price=float(i), margin=0.25) for i in range(1, 6)])
    s = D.summary_margin(D.dataset_summary(tx)).first()
    assert abs(s.margin_pct - 25.0) < 1e-9
    assert [r.net_revenue for r in D.preview(tx, 2, "purchase_ts").collect()] == [1.0, 2.0]
    assert [r.net_revenue for r in D.preview(tx, 2, "purchase_ts", last=True).collect()] == [4.0, 5.0]


def test_a_product_without_revenue_never_ranks_first(spark, make_tx, make_products):
    from pyspark.sql import functions as F

    from shelfwise.operators import forecast as FC

    tx = make_tx([sale("a", 1, 1, "2023-01-01"), sale("b", 1, 2, "2023-01-01")])
    tx = tx.withColumns(
        {c: F.when(F.col("product_id") != 2, F.col(c)) for c in ("net_revenue", "profit")}
    )
    prod = make_products([(1, "S1", "A", 2.0, 0.3, 1), (2, "S2", "B", 2.0, 0.3, 1)])
    assert FC.top_skus_by_revenue(tx, 1).first().product_id == 1
    top = D.top_products(tx, 2, prod).collect()
    assert [(r.product_id, r.revenue) for r in top] == [(1, 10.0), (2, 0.0)]
    by_category = D.category_join_rollup(tx, prod).collect()
    assert [(r.category, r.rev, r.profit) for r in by_category] == [("A", 10.0, 5.0), ("B", 0.0, 0.0)]


def test_hot_keys_are_summed_before_the_dimension_join(spark):
    """With broadcast off, what is shuffled to the join is one row per key."""
    from shelfwise.plans import inspect as P
    from shelfwise.sources import tpch
    from tests.conftest import SF_SMALL

    t = tpch.retail_tables(spark, SF_SMALL)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for q in (D.revenue_by_country(t.transactions, t.customers), D.top_products(t.transactions, 5, t.products)):
            plan = P.formatted_plan(q)
            assert "partial_sum" in plan
        by_hand = D.revenue_by_country(
            t.transactions.join(t.customers.select("customer_id", "country"), "customer_id", "left")
        ).collect()
        assert D.revenue_by_country(t.transactions, t.customers).collect() == by_hand
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
