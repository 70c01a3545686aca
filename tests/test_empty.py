"""Empty transactions: every family returns an empty (or zero) result with
its columns, rather than failing."""

from __future__ import annotations

from shelfwise.operators import cohort as C
from shelfwise.operators import descriptive as D
from shelfwise.operators import forecast as FC
from shelfwise.operators import prescriptive as X
from shelfwise.operators import rfm as R


def test_empty_inputs(spark, make_tx, make_products):
    tx = make_tx([])
    prod = make_products([(1, "S1", "A", 10.0, 0.3, 50)])
    assert D.revenue_over_time(tx).count() == 0
    assert D.rolling_revenue(tx).count() == 0
    rfm = R.compute_rfm(tx)
    assert rfm.count() == 0 and rfm.columns == R.RFM_COLUMNS
    assert R.tier_summary(rfm).count() == 0
    ar = R.at_risk_revenue(R.at_risk_customers(rfm)).first()
    assert ar.customers == 0 and ar.dollars_at_risk == 0.0
    assert [r.customers for r in R.tier_lookup(R.tier_summary(rfm)).collect()] == [0, 0, 0, 0]
    m = C.monthly_cohort_matrix(tx)
    assert m.count() == 0 and m.columns == C.MATRIX_COLUMNS
    assert C.cohort_heatmap_pivot(m, 3).columns == ["cohort_month", "0", "1", "2", "3"]
    rows = FC.forecast_rows(tx, None, 7, 30)
    assert rows.count() == 0
    rep = X.reorder_report(FC.forecasts(rows, prod), FC.backtest(rows), prod)
    assert rep.count() == 0 and rep.columns == X.REPORT_COLUMNS
    assert {r.status: r["count"] for r in X.status_counts(rep).collect()} == {
        "red": 0, "yellow": 0, "green": 0}
    dead = X.dead_stock(tx, prod)
    assert [r.product_id for r in dead.collect()] == [1]  # nothing sold: all stock is dead
    assert FC.daily_units(tx).count() == 0
