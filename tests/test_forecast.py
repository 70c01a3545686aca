"""Daily series, Holt-Winters fits, accuracy, bands."""

from __future__ import annotations

import re
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfwise.functions import holtwinters as H
from shelfwise.functions.holtwinters import fit_many, run_fixed
from shelfwise.operators import forecast as FC
from shelfwise.plans.catalog import QUERIES
from shelfwise.sources import tpch
from tests.conftest import SF_SMALL, sale


def _brute_fitted(y, a, b, g, m=7):
    """Reference recursion, one step at a time in plain Python."""
    n = len(y)
    if n >= 2 * m:
        first = sum(y[:m]) / m
        tr = (sum(y[m:2 * m]) / m - first) / m
        lvl = first - tr * (m + 1) / 2
        s = [y[i] - (first + tr * (i - (m - 1) / 2)) for i in range(m)]
    else:
        tr = y[1] - y[0]
        lvl, s, g = y[0] - tr, [0.0] * m, 0.0
    out = []
    for t in range(n):
        j = t % m
        lb = lvl + tr
        out.append(lb + s[j])
        nl = a * (y[t] - s[j]) + (1 - a) * lb
        nb = b * (nl - lvl) + (1 - b) * tr
        s[j] = g * (y[t] - lb) + (1 - g) * s[j]
        lvl, tr = nl, nb
    return out


def _daily_rows(pid, start, units):
    day0 = date.fromisoformat(start)
    return [sale(f"I{pid}-{i}", 1, pid, str(day0 + timedelta(days=i)), qty=int(u))
            for i, u in enumerate(units) if u]


def test_daily_units_densifies(make_tx):
    tx = make_tx(_daily_rows(1, "2023-01-01", [2, 0, 0, 5]) + _daily_rows(2, "2023-02-01", [1]))
    rows = FC.daily_units(tx).orderBy("product_id", "ds").collect()
    assert [(r.product_id, str(r.ds), r.y) for r in rows] == [
        (1, "2023-01-01", 2), (1, "2023-01-02", 0), (1, "2023-01-03", 0), (1, "2023-01-04", 5),
        (2, "2023-02-01", 1)]


def _planned(df) -> str:
    """The physical plan as one session without re-planning would run it."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_dense_rows_are_made_in_generated_code(spark, make_tx):
    tx = make_tx(_daily_rows(1, "2023-01-01", [2, 0, 0, 5]))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _planned(FC.daily_units(tx))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert re.search(r"\*\(\d+\) Generate explode", plan), plan


def test_lag_of_the_dense_series(spark, make_tx):
    rows = _daily_rows(1, "2023-01-01", [2, 0, 0, 5, 1, 0, 0, 0, 7, 0, 0, 0, 0, 0, 0, 0, 0, 0, 3])
    rows += _daily_rows(2, "2023-02-01", [1]) + _daily_rows(3, "2023-02-01", [4, 4, 4])
    unknown = with_null_units(make_tx(rows), "I1-3")
    dense = FC.daily_units(unknown, lag_days=2)
    w = Window.partitionBy("product_id").orderBy("ds")
    got = dense.withColumn("want", F.lag("y", 2).over(w)).collect()
    assert len(got) == 23 and all(r.y_lag == r.want for r in got)
    assert sum(r.y_lag is None for r in got) == 2 + 1 + 1 + 2  # the unknown units, and three beginnings
    plan = _planned(dense)
    assert plan.count("Generate explode") == 1 and "Sort" not in plan.split("Generate explode")[0]


def with_null_units(tx, invoice):
    return tx.withColumn("quantity", F.when(F.col("invoice_id") != invoice, F.col("quantity")))


def test_history_is_not_rounded_row_by_row(spark):
    plan = QUERIES["history_and_forecast_mean"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan()
    history = [x for x in plan.toString().splitlines() if "history AS series" in x]
    assert len(history) == 1 and "round(" not in history[0]


def test_fixed_parameters_match_brute_force(make_tx):
    rng = np.random.default_rng(1)
    units = [list(rng.poisson(3, n) + 1) for n in (10, 13, 14, 40)]
    rows = []
    for pid, u in enumerate(units, start=1):
        rows += _daily_rows(pid, "2023-01-01", u)
    out = FC.fixed_parameter_fit(make_tx(rows), 0.3, 0.05, 0.1).orderBy("product_id", "t").collect()
    for pid, u in enumerate(units, start=1):
        got = [r.fitted for r in out if r.product_id == pid]
        want = _brute_fitted([float(v) for v in u], 0.3, 0.05, 0.1)
        assert np.allclose(got, want, rtol=0, atol=1e-9), pid


def test_kernel_forecasts_lines_exactly():
    line = np.arange(20, dtype=float)
    f = fit_many([line])
    assert f.seasonal[0] and np.allclose(f.forecast(3)[0], [20, 21, 22], atol=1e-9)
    wave = 10 + 0.5 * np.arange(42) + np.tile([3, -1, -2, 0, 1, -3, 2], 6)
    g = fit_many([wave])
    nxt = 10 + 0.5 * np.arange(42, 49) + np.array([3, -1, -2, 0, 1, -3, 2])
    assert np.allclose(g.forecast(7)[0], nxt, atol=1e-6) and g.sigma[0] < 1e-9


def test_kernel_trend_only_below_two_seasons():
    y13 = np.arange(13, dtype=float)
    y14 = np.arange(14, dtype=float)
    f = fit_many([y13, y14])
    assert list(f.seasonal) == [False, True]
    # a straight line is forecast exactly by the trend-only model
    assert np.allclose(f.forecast(3)[0], [13, 14, 15], atol=1e-6)
    fitted, _ = run_fixed([y13], 0.5, 0.1, 0.3)
    assert np.allclose(fitted[0], _brute_fitted(list(y13), 0.5, 0.1, 0.3))


def test_min_history_and_backtest_window(make_tx):
    rng = np.random.default_rng(2)
    rows = []
    for pid, n in ((1, 1), (2, 59), (3, 60), (4, 61), (5, 90)):
        rows += _daily_rows(pid, "2023-01-01", list(rng.poisson(4, n) + 1))
    fr = FC.forecast_rows(make_tx(rows), None, 14, 30)
    got = {}
    for r in fr.collect():
        got.setdefault((r.product_id, r.kind), []).append(r)
    assert {p for p, _ in got} == {3, 4, 5}  # no forecast below 60 days
    assert len(got[(3, "backtest")]) == 12    # 60 ≤ 30 + 30 → max(7, 60 // 5)
    assert len(got[(5, "backtest")]) == 30
    assert all(len(got[(p, "forecast")]) == 14 for p in (3, 4, 5))
    last = date(2023, 1, 1) + timedelta(days=89)
    assert min(r.ds for r in got[(5, "forecast")]) == last + timedelta(days=1)


def test_forecast_bands_and_accuracy(spark):
    tx = tpch.transactions(spark, SF_SMALL)
    rows = FC.forecast_rows(tx, FC.top_skus_by_revenue(tx, 5), 14, 14).cache()
    fc = FC.forecasts(rows, tpch.products(spark, SF_SMALL)).collect()
    assert fc and all(r.yhat_lower <= r.yhat <= r.yhat_upper for r in fc)
    assert all(r.yhat_lower >= 0 for r in fc)
    assert all(r.sku.startswith("SKU-") for r in fc)
    bt = FC.backtest(rows).collect()
    assert bt and all(r.mape >= 0 and r.rmse >= 0 for r in bt)


def test_accuracy_zero_actuals_use_denominator_one(spark):
    df = spark.createDataFrame([(1, 0.0, 2.0), (1, 0.0, 0.0), (2, 4.0, 2.0)],
                               "product_id long, actual double, yhat double")
    r = {x.product_id: x for x in FC.forecast_accuracy(df).collect()}
    assert r[1].mape == 100.0 and r[1].rmse == np.sqrt(2.0)
    assert r[2].mape == 50.0


def test_top_skus(spark):
    tx = tpch.transactions(spark, SF_SMALL)
    ids = [r.product_id for r in FC.top_skus_by_revenue(tx, 5).collect()]
    assert len(ids) <= 5 and all(isinstance(i, int) for i in ids)


def test_history_and_forecast_union(make_tx):
    rng = np.random.default_rng(4)
    tx = make_tx(_daily_rows(1, "2023-01-01", list(rng.poisson(4, 70) + 1)))
    hf = FC.history_and_forecast(FC.daily_units(tx), FC.forecasts(FC.forecast_rows(tx, None, 10)))
    counts = {r.series: r["count"] for r in hf.groupBy("series").count().collect()}
    assert counts == {"history": 70, "forecast": 10}


def test_forecast_rows_match_direct_kernel(spark, make_tx, make_products):
    """Spark plumbing (densify, batches, dates, bands, backtest window)
    against the kernel called directly on the same series."""
    import pandas as pd

    from shelfwise.operators import prescriptive as X

    rng = np.random.default_rng(7)
    series = {}
    rows = []
    for pid, n in ((3, 75), (700, 64), (1500, 95)):     # three different batches
        u = rng.poisson(3, n) * (rng.random(n) < 0.7)
        u[0] = u[-1] = 1                                # first and last day sold
        rows += _daily_rows(pid, "2023-03-01", [int(v) for v in u])
        series[pid] = u.astype(float)
    tx = make_tx(rows)
    got = FC.forecast_rows(tx, None, 14, 30).toPandas()
    for pid, y in series.items():
        td = FC.backtest_days(len(y), 30)
        tfit = fit_many([y[:-td]])
        ffit = fit_many([y])
        g = got[got.product_id == pid].sort_values(["kind", "step"])
        bt = g[g.kind == "backtest"]
        assert np.allclose(bt.yhat, tfit.forecast(td)[0], rtol=0, atol=1e-9)
        assert np.array_equal(bt.actual.to_numpy(), y[-td:])
        fc = g[g.kind == "forecast"]
        assert np.allclose(fc.yhat, ffit.forecast(14)[0], rtol=0, atol=1e-9)
        assert np.allclose(fc.sigma, ffit.sigma[0], rtol=0, atol=1e-12)
        last = date(2023, 3, 1) + timedelta(days=len(y) - 1)
        assert list(fc.ds) == [last + timedelta(days=h) for h in range(1, 15)]

    # reorder report against a pandas recomputation from the same rows
    prod = make_products([(3, "S3", "A", 2.0, 0.3, 10), (700, "S700", "B", 2.0, 0.3, 1000)])
    rows_df = spark.createDataFrame(got)
    fcf = FC.forecasts(rows_df, prod).toPandas()
    acc = FC.backtest(rows_df).toPandas().set_index("product_id")
    rep = X.reorder_report(FC.forecasts(rows_df, prod), FC.backtest(rows_df), prod, 7, 1.65)
    rep = rep.toPandas().set_index("product_id")
    for pid in series:
        w = fcf[(fcf.product_id == pid) & (fcf.step <= 7)]
        demand = w.yhat.sum()
        sigma = (w.yhat_upper - w.yhat).mean() / 1.96
        r = rep.loc[pid]
        assert np.isclose(r.expected_demand, demand) and np.isclose(r.safety_stock, 1.65 * sigma * np.sqrt(7))
        assert np.isclose(r.mape_pct, acc.loc[pid].mape)
        stock = {3: 10, 700: 1000}.get(pid)
        want = ("green" if stock is None else "red" if stock < demand
                else "yellow" if stock < demand + 1.65 * sigma * np.sqrt(7) else "green")
        assert r.status == want
    assert pd.isna(rep.loc[1500].stock_on_hand)


def test_forecast_product_single_id(spark):
    tx = tpch.transactions(spark, SF_SMALL)
    pid = FC.top_skus_by_revenue(tx, 1).first().product_id
    fc, bt = FC.forecast_product(tx, pid, tpch.products(spark, SF_SMALL), 7, 14, 0.8)
    rows = fc.collect()
    assert len(rows) == 7 and {r.product_id for r in rows} == {pid}
    assert bt.count() == 1


def test_rows_without_product_or_date_are_ignored(spark, make_tx):
    rng = np.random.default_rng(5)
    rows = _daily_rows(1, "2023-01-01", [int(v) + 1 for v in rng.poisson(3, 70)])
    rows.append(sale("X", 1, None, "2023-01-05", qty=4))
    tx = make_tx(rows).unionByName(
        make_tx([sale("Y", 1, 1, "2023-01-06", qty=9)]).withColumn("purchase_date", F.lit(None).cast("date"))
    )
    fr = FC.forecast_rows(tx, None, 7, 30).collect()
    assert {r.product_id for r in fr} == {1}
    d = FC.daily_units(tx).collect()
    assert {r.product_id for r in d} == {1} and len(d) == 70


def test_align_end_and_season_length(make_tx):
    rng = np.random.default_rng(9)
    rows = _daily_rows(1, "2023-01-01", [int(v) + 1 for v in rng.poisson(3, 80)])
    rows += _daily_rows(2, "2023-01-10", [int(v) + 1 for v in rng.poisson(3, 65)])
    tx = make_tx(rows)
    end = date(2023, 3, 31)
    fr = FC.forecast_rows(tx, None, 5, 30, align_end=end).filter("kind = 'forecast'").collect()
    firsts = {r.product_id: r.ds for r in fr if r.step == 1}
    assert firsts == {1: end + timedelta(days=1), 2: end + timedelta(days=1)}
    plain = FC.forecast_rows(tx, None, 5, 30, seasonal_periods=5).filter("kind = 'forecast'")
    firsts = {r.product_id: r.ds for r in plain.collect() if r.step == 1}
    assert firsts == {1: date(2023, 3, 22), 2: date(2023, 3, 16)}


def test_forecast_many_wrapper(spark):
    tx = tpch.transactions(spark, SF_SMALL)
    fc, bt = FC.forecast_many(tx, FC.top_skus_by_revenue(tx, 3), 14, tpch.products(spark, SF_SMALL))
    assert fc.count() == 14 * bt.count() and bt.count() >= 1


def _dense_grid_sse(series, m=7):
    from shelfwise.functions import holtwinters as H

    bt = H._Batch(series, m)
    axes = (np.linspace(0.001, 1, 21), np.linspace(0, 1, 17), np.linspace(0, 1, 17))
    grid = np.stack(np.meshgrid(*axes, indexing="ij"), -1).reshape(-1, 3)
    cube = np.broadcast_to(grid, (len(series), *grid.shape))
    return bt.unpack(bt.run(*H._parameters(cube, bt.seasonal))[4].min(axis=1))


def test_fit_is_no_worse_than_a_dense_grid_over_the_whole_region():
    rng = np.random.default_rng(2)
    for n in (60, 75, 200):
        t = np.arange(n)
        drift = np.cumsum(rng.normal(0, 1.0, (n // 7 + 1, 7)), axis=0)[t // 7, t % 7]
        series = [
            20 + drift + rng.normal(0, 1, n),  # a season that changes
            10 + np.cumsum(np.cumsum(rng.normal(0, 0.05, n))) + rng.normal(0, 1, n),  # a trend that does
            (rng.poisson(3, n) * (rng.random(n) < 0.4)).astype(float),
        ]
        assert (fit_many(series).sse <= 1.01 * _dense_grid_sse(series)).all()
        assert (fit_many(series, estimate=False).sse <= 1.04 * _dense_grid_sse(series)).all()


def test_mean_forecast_by_hand(make_tx):
    units = [1] * 40 + [0] * 10 + [2] * 15 + [5] * 5  # 70 days
    rows = _daily_rows(1, "2023-01-01", units) + _daily_rows(2, "2023-01-01", [1] * 59)
    got = FC.mean_forecast_rows(FC.daily_sales(make_tx(rows)), 3, 14, 28).toPandas()
    assert set(got.product_id) == {1}  # 59 days are too few
    fc, bt = got[got.kind == "forecast"], got[got.kind == "backtest"].sort_values("step")
    last, train = np.array(units[-28:], float), np.array(units[-42:-14], float)
    assert np.allclose(fc.yhat, last.mean()) and np.allclose(fc.sigma, last.std())
    assert list(bt.actual) == units[-14:] and np.allclose(bt.yhat, train.mean())
    assert sorted(fc.ds)[0] == date(2023, 1, 1) + timedelta(days=70)


def _given_series(spark, folder=SF_SMALL):
    daily = FC.daily_units(tpch.transactions(spark, folder)).orderBy("product_id", "ds").toPandas()
    return [g.to_numpy(float) for _, g in daily.groupby("product_id")["y"] if len(g) > 1]


def test_fit_is_never_worse_than_the_grid_or_the_given_state(spark):
    from shelfwise.functions.holtwinters import GRID, grid_fit

    series = _given_series(spark)
    fit, grid = fit_many(series), grid_fit(series)
    assert (fit.sse <= grid.sse * (1 + 1e-9) + 1e-9).all()
    assert (fit.sse <= fit_many(series, estimate=False).sse * (1 + 1e-9) + 1e-9).all()
    for i in range(0, len(series), 17):  # the grid's choice, cell by cell in plain Python
        cells = [(a, b, g if len(series[i]) >= 14 else 0.0) for a, b, g in GRID]
        errors = [sum((y - f) ** 2 for y, f in zip(series[i], _brute_fitted(series[i], *c))) for c in cells]
        best = int(np.argmin(errors))
        assert (grid.alpha[i], grid.beta[i], grid.gamma[i]) == cells[best]
        assert np.isclose(grid.sse[i], errors[best])


def test_fit_is_settled(spark):
    """No small move of the parameters, with the state projected anew, lowers the error much."""
    from shelfwise.functions import holtwinters as H

    series = [s for s in _given_series(spark) if len(s) > 100][:20]
    fit = fit_many(series)
    bt = H._Batch(series, 7)
    order = bt.order
    cube = np.stack([fit.alpha, fit.beta / fit.alpha, np.where(fit.alpha < 1, fit.gamma / (1 - fit.alpha), 0)], 1)[order]
    for axis in range(3):
        for step in (-0.01, 0.01):
            near = cube.copy()
            near[:, axis] = np.clip(near[:, axis] + step, 1e-3 if axis == 0 else 0, 1)
            a, b, g = H._parameters(near[:, None, :], bt.seasonal)
            seen = bt.responses(np.arange(len(series)), a, a * b, g, bt.given_state()[:, None, :], False)
            assert (H._projected(seen[:, 0], 9)[1] >= fit.sse[order] * 0.98).all()


def test_batches_cost_alike(make_tx, monkeypatch):
    monkeypatch.setattr(FC, "BATCH_DAYS", 3_000)
    rows = []
    for pid in range(200):
        for day in (0, 20 + 7 * (pid % 40)):
            rows += [sale(f"I{pid}-{day}", 1, pid * 1000, str(date(2023, 1, 1) + timedelta(days=day)))]
    daily = FC.daily_sales(make_tx(rows))
    batches, n = FC.product_batches(daily)
    span = F.datediff(F.max("ds"), F.min("ds")) + 1
    days = daily.groupBy("product_id").agg(span.alias("days")).join(batches, "product_id")
    cost = [r.cost for r in days.groupBy("batch").agg(F.sum("days").alias("cost")).collect()]
    assert len(cost) == n > 8 and max(cost) <= 1.5 * sum(cost) / n and max(cost) <= 3_000 * 1.1
    state = {r.product_id: r for r in FC.fixed_parameter_state(make_tx(rows)).collect()}
    assert len(state) == 200 and all(state[p * 1000].days == 21 + 7 * (p % 40) for p in range(200))


def test_batches_of_nothing(make_tx):
    assert FC.forecast_rows(make_tx([]), None, 14, 30).collect() == []


def test_columns_of_the_errors_match_runs_of_their_own():
    """The products come of three runs; here each column is run by itself."""
    rng = np.random.default_rng(8)
    series = [rng.poisson(2.0, n).astype(float) for n in (150, 129, 128, 64, 40, 13, 9)]
    bt = H._Batch(series, 7)
    p, d = len(series), 9
    alpha, gamma = rng.uniform(0.05, 0.9, p), rng.uniform(0.0, 0.1, p) * bt.seasonal
    ab = alpha * rng.uniform(0.0, 0.5, p)
    state = bt.given_state()
    seen = bt.responses(np.arange(p), *(x[:, None] for x in (alpha, ab, gamma)), state[:, None, :], True)[:, 0]
    for i in range(p):
        n = int(bt.n[i])

        def errors(y, l, b, s, add=(None, None, None)):
            out, s = [], list(s)
            for t in range(n):
                e = y[t] - (l + b + s[t % 7])
                out.append(e)
                l, b = l + b + alpha[i] * e, b + ab[i] * e
                s[t % 7] += gamma[i] * e
                if add[0] is not None:
                    l, b = l + add[0][t], b + add[1][t]
                    s[t % 7] += add[2][t]
            return np.array(out)

        zero = np.zeros(n)
        e = errors(bt.y[i], state[i, 0], state[i, 1], state[i, 2:])
        units = np.eye(d)
        columns = [e] + [errors(zero, *u[:2], u[2:]) * (bt.seasonal[i] or j < 2) for j, u in enumerate(units)]
        columns += [errors(zero, 0, 0, units[0][2:], add) for add in ((e, zero, zero), (zero, e, zero), (zero, zero, e))]
        want = np.array(columns) @ np.array(columns).T
        if not bt.seasonal[i]:  # no season: what γ changes is not used
            want[-1], want[:, -1] = seen[i, -1], seen[i, :, -1]
        size = np.sqrt(np.outer(np.diag(want), np.diag(want))) + 1e-9
        assert (np.abs(seen[i] - want) / size).max() < 1e-9, (i, n)


def test_a_fit_costs_fewer_array_elements(monkeypatch):
    """Three runs carry all error columns of a pass; thirteen were carried before."""
    asked = []

    def zeros(shape, *more):
        asked.append(int(np.prod(shape)))
        return make(shape, *more)

    make = np.zeros
    bt = H._Batch([np.arange(200.0) % 5 for _ in range(50)], 7)
    at = np.full((50, 1), 0.2)
    monkeypatch.setattr(H.np, "zeros", zeros)
    bt.responses(np.arange(50), at, at * 0.1, at, bt.given_state()[:, None, :], True)
    assert max(asked) <= 3 * (14 + 64) * 50


def test_dates_reach_arrow_without_objects(make_tx):
    run = FC._fixed_batch(0.3, 0.05, 0.1)
    got = run(pd.DataFrame({"product_id": [1, 1], "ds": [date(2023, 1, 1), date(2023, 1, 4)], "y": [2, 3]}))
    assert got["ds"].dtype == "datetime64[D]" and list(got["t"]) == [0, 1, 2, 3]
    out = FC.fixed_parameter_fit(make_tx(_daily_rows(1, "2023-01-01", [2, 0, 0, 3]))).orderBy("t").collect()
    assert [str(r.ds) for r in out] == ["2023-01-01", "2023-01-02", "2023-01-03", "2023-01-04"]


def _lengths(*ns, seed=4):
    rng = np.random.default_rng(seed)
    return [rng.poisson(2.0, n) * (rng.random(n) < 0.5) + np.sin(np.arange(n)) ** 2 for n in ns]


def test_two_fits_share_one_run_of_the_grid(monkeypatch):
    """Both fits of a batch start from one pass of the grid's cells, which took two
    passes and two more for the projections before; only the last passes are runs."""
    calls = {"run": [], "responses": 0, "judge": 0}
    run, responses, judge = H._Batch.run, H._Batch.responses, H._Batch.judge

    def counted(self, alpha, *more, **named):
        calls["run"].append(alpha.shape[1])
        return run(self, alpha, *more, **named)

    def passes(self, rows, alpha, *more):
        calls["responses"] += 1
        assert alpha.shape[1] == 1
        return responses(self, rows, alpha, *more)

    def judged(self, cells, ends):
        calls["judge"] += 1
        return judge(self, cells, ends)

    for name, to in (("run", counted), ("responses", passes), ("judge", judged)):
        monkeypatch.setattr(H._Batch, name, to)
    days = pd.date_range("2023-01-01", periods=150).date
    rows = [(pid, d, 1 + (i * pid) % 5) for pid in (1, 2, 3) for i, d in enumerate(days[: 150 - 20 * pid])]
    FC._forecast_batch(7, 30, 60, 7, None)(pd.DataFrame(rows, columns=["product_id", "ds", "y"]))
    assert calls["judge"] == 1 and calls["run"] == [1, 1] and 2 <= calls["responses"] <= 2 * H.PASSES


@pytest.mark.parametrize("m", [1, 5, 7, 70])
def test_fit_twice_gives_the_fits_of_each_length(m):
    series = _lengths(400, 333, 190, 127, 126, 91, 61, 60, 60)
    held = np.array([30, 30, 30, 1, 63, 30, 30, 12, 7])
    got = H.fit_twice(series, held, m)
    for fit, each in zip(got, ([y[:-h] for y, h in zip(series, held)], series)):
        for i, y in enumerate(each):  # alone, so that no other series is in the arrays
            one = fit_many([y], m)
            assert fit.n[i] == len(y)
            assert np.isclose(fit.sse[i], one.sse[0], rtol=1e-7) and np.isclose(fit.sigma[i], one.sigma[0], rtol=1e-6)
            assert np.allclose(fit.forecast(9)[i], one.forecast(9)[0], rtol=1e-5, atol=1e-6)


def test_unknown_units_of_the_test_days_do_not_reach_the_fit_without_them():
    series = _lengths(200, 150, 130)
    known = [y.copy() for y in series]
    series[1][-3] = np.nan
    train, whole = H.fit_twice(series, np.full(3, 30))
    want = fit_many([y[:-30] for y in known])
    assert np.allclose(train.forecast(30), want.forecast(30), rtol=1e-6) and np.allclose(train.sse, want.sse)
    assert np.isnan(whole.forecast(5)[1]).all() and not np.isnan(whole.forecast(5)[[0, 2]]).any()


def test_the_grid_is_judged_as_by_passes_of_its_cells():
    series = _lengths(300, 189, 150, 126, 64, 63, 20)
    bt = H._Batch(series, 7)
    p = len(series)
    cells = np.array([(a, a * b, g) for a, b, g in H.GRID])
    ends = [bt.n, np.maximum(bt.n - np.array([30, 63, 1, 7, 30, 30, 6]), 14)]
    for end, (sse, products) in zip(ends, bt.judge(cells, ends)):
        short = H._Batch([bt.y[i, :n] for i, n in enumerate(end)], 7)
        first = bt.given_state()[short.order]
        for c, cell in enumerate(cells):
            rates = (np.full((p, 1), x) for x in cell)
            want = short.unpack(short.responses(np.arange(p), *rates, first[:, None, :], False)[:, 0])
            seen = products(np.arange(p), np.full(p, c))
            size = np.sqrt(np.einsum("px,py->pxy", *2 * [np.einsum("pxx->px", want)])) + 1e-9
            assert (np.abs(seen - want) / size).max() < 1e-9
            assert np.allclose(sse[:, c], want[:, 0, 0])
