"""Per-product daily demand forecasts.

Plan for ``forecast_rows``:

1. daily units per (product, day) — partial + final aggregate; a product
   with a third of all rows still yields one row per day;
2. products are dealt to batches by their measured days of history, so
   batches cost alike and are bounded in days, independent of volume;
3. each batch is one partition, where ``mapInArrow`` densifies each series
   (missing days → 0) and fits all of them together (``functions.holtwinters``):
   a fit on the series minus its last ``test_days`` for the backtest, and a
   fit on the whole series for the forward forecast;
4. it emits flat rows — backtest steps (actual, prediction) and forecast
   steps (prediction, residual σ) — so accuracy (F4), bands and the reorder
   report are ordinary Spark aggregates and projections over them.
"""

from __future__ import annotations

from datetime import date

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from shelfwise.functions.holtwinters import fit_twice, grid_fit, run_fixed
from shelfwise.functions.measures import money_sum
from shelfwise.functions.ranking import with_dense_rank
from shelfwise.session import default_parallelism, hold, ship_package

# A batch's days of history at most, beyond one product's, and the products that
# are worth a batch of their own when cores are idle.
BATCH_DAYS = 2_400_000
BATCH_SMALLEST = 16
ROWS_A_PIECE = 100_000  # of a batch's result, handed back at once

# Minimum days of history for a forecast, season length in
# days, band z for a confidence level of at least 0.95 and below it, and the
# backtest window rule — a series of at most test_days + 30 days backtests on
# max(7, days // 5) days instead.
MIN_HISTORY_DAYS = 60
SEASON = 7
Z_HIGH = 1.96
Z_LOW = 1.28
BACKTEST_SLACK_DAYS = 30
BACKTEST_MIN_DAYS = 7
BACKTEST_DIVISOR = 5

ROWS_SCHEMA = (
    "product_id long, kind string, step int, ds date, actual double, yhat double, sigma double"
)
ROWS_SCHEMA_COLUMNS = [c.split()[0] for c in ROWS_SCHEMA.split(",")]


def top_skus_by_revenue(df: DataFrame, n: int = 50) -> DataFrame:
    """product_id of the n products with most revenue (ties by id)."""
    return (
        df.groupBy("product_id")
        .agg(money_sum("net_revenue").alias("rev"))
        .orderBy(F.desc_nulls_first("rev"), "product_id")
        .limit(n)
        .select("product_id")
    )


def top_skus_with_labels(df: DataFrame, products: DataFrame, n: int = 50) -> DataFrame:
    """(product_id, sku) of the top n products: one pass over the facts,
    then n rows joined with the products."""
    ids = top_skus_by_revenue(df, n)
    return ids.join(products.select("product_id", "sku"), "product_id", "left").distinct()


def daily_sales(df: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Units per (product_id, ds) for days with sales. Rows without a
    product or a date belong to no series and are left out."""
    df = df.filter(F.col("product_id").isNotNull() & F.col("purchase_date").isNotNull())
    if ids is not None:
        df = df.join(ids.select("product_id"), "product_id", "left_semi")
    return df.groupBy("product_id", F.col("purchase_date").alias("ds")).agg(
        F.sum("quantity").cast("long").alias("y")
    )


def daily_units(
    df: DataFrame, ids: DataFrame | None = None, lag_days: int | None = None
) -> DataFrame:
    """product_id, ds, y — every day from each product's own first to
    last sale, days without sales as 0. With ``lag_days`` also y_lag, the units
    that many days before (null before the first sale).

    One shuffle on product_id gathers each product's daily sales (bounded by
    its days of history, not by its number of transactions). In date order each
    sale stands for itself and the days up to the next one, so ``explode`` makes
    the dense series in linear time, in generated code. Only sales are sorted,
    never dense rows; no spine join, no second shuffle.
    """
    return densify(daily_sales(df, ids), lag_days)


def densify(daily: DataFrame, lag_days: int | None = None) -> DataFrame:
    """F2 over ``daily_sales`` that other branches may share.

    The number of tasks is set here: a sale makes many dense rows, and AQE would
    merge tasks by the bytes of the sales.
    """
    spark = daily.sparkSession
    tasks = max(4 * default_parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    w = Window.partitionBy("product_id").orderBy("ds")
    sales = daily.repartition(tasks, "product_id").withColumn(
        "days", F.coalesce(F.datediff(F.lead("ds").over(w), "ds"), F.lit(1))
    )
    back = []
    if lag_days is not None:
        # A day's units ``lag_days`` before are those of a sale at most so far
        # before the day's own sale, or zero.
        day = Window.partitionBy("product_id").orderBy("day")
        sales = sales.withColumn("day", F.unix_date("ds")).withColumns({
            "first": F.min("day").over(day),
            "near": F.map_from_entries(
                F.collect_list(F.struct("day", "y")).over(day.rangeBetween(-lag_days, 0))
            ),
        })
        at = F.col("day") + F.col("i") - F.lit(lag_days)
        sold = F.map_contains_key("near", at)
        back = [
            F.when((F.col("i") <= lag_days) & sold, F.col("near")[at])
            .when(at >= F.col("first"), F.lit(0).cast("long"))
            .alias("y_lag")
        ]
    # Never empty; the outer form spares a filter that makes the sequence once more.
    each = F.explode_outer(F.sequence(F.lit(0), F.col("days") - F.lit(1)))
    return sales.select("*", each.alias("i")).select(
        "product_id",
        F.date_add("ds", F.col("i")).alias("ds"),
        F.when(F.col("i") == 0, F.col("y")).otherwise(F.lit(0)).cast("long").alias("y"),
        *back,
    )


def product_batches(daily: DataFrame, end_day: int | None = None) -> tuple[DataFrame, int]:
    """(product_id, batch) of all products, and the number of batches.

    Cut by measured days of history, since that is what a fit costs: products
    are ranked by their days and dealt in turn, so every batch gets as many
    long and short series as the others and none holds more than about
    ``BATCH_DAYS`` days (one product's history being the least there is). There are
    batches for all cores even when few days would fill fewer.
    """
    last = F.unix_date(F.max("ds"))
    if end_day is not None:
        last = F.greatest(last, F.lit(end_day))
    spans = hold(
        daily.groupBy("product_id").agg((last - F.unix_date(F.min("ds")) + 1).cast("long").alias("days"))
    )
    size = spans.agg(F.count("*").alias("products"), F.sum("days").alias("days")).first()
    if not size.products:
        return spans.select("product_id", F.lit(0).alias("batch")), 1
    cores = default_parallelism(daily.sparkSession)
    batches = max(-(-size.days // BATCH_DAYS), min(-(-size.products // BATCH_SMALLEST), 2 * cores))
    ranked = with_dense_rank(spans, ["days", "product_id"])
    return ranked.select("product_id", (F.col("rank") % batches).cast("int").alias("batch")), batches


def _per_batch(daily: DataFrame, run, schema: str, end_day: int | None = None) -> DataFrame:
    """``run`` over the daily rows of each batch of products.

    A batch is one partition, named by its number, so that no two batches meet
    in a task and AQE does not merge them (they are small in bytes, dear in
    time). ``run`` gives a column of NumPy values by name, dates as datetime64[D]:
    Arrow takes them as they are, without a Python object a row. The package is
    shipped to the workers first.
    """
    ship_package(daily.sparkSession)
    daily = hold(daily)
    batches, n = product_batches(daily, end_day)

    types = to_arrow_schema(StructType.fromDDL(schema))

    def whole(parts):
        frames = list(parts)
        if not frames:
            return
        got = run(pa.Table.from_batches(frames).to_pandas(date_as_object=False))
        for a in range(0, len(got["product_id"]), ROWS_A_PIECE):
            yield pa.RecordBatch.from_arrays(
                [pa.array(got[f.name][a : a + ROWS_A_PIECE], f.type, from_pandas=True) for f in types],
                schema=types,
            )

    return (
        daily.join(batches, "product_id")
        .repartitionById(n, F.col("batch"))
        .select("product_id", "ds", "y")
        .mapInArrow(whole, schema)
    )


def _dense(g: pd.DataFrame, end_day: int | None = None):
    """Split a batch frame into dense per-product series:
    [(product_id, first day as datetime64[D], units per day)]. With
    ``end_day`` (days since the epoch) a series ending earlier is extended
    with zero days up to it."""
    pid = g["product_id"].to_numpy(dtype=np.int64)
    day = pd.to_datetime(g["ds"]).to_numpy().astype("datetime64[D]").astype(np.int64)
    y = g["y"].to_numpy(dtype=float)
    order = np.lexsort((day, pid))
    pid, day, y = pid[order], day[order], y[order]
    cut = np.flatnonzero(np.r_[True, pid[1:] != pid[:-1], True])
    out = []
    for a, b in zip(cut[:-1], cut[1:]):
        d0 = day[a]
        last = day[b - 1] if end_day is None else max(day[b - 1], end_day)
        dense = np.zeros(int(last - d0) + 1)
        np.add.at(dense, day[a:b] - d0, y[a:b])
        out.append((int(pid[a]), np.datetime64(int(d0), "D"), dense))
    return out


def backtest_days(n: int, test_days: int) -> int:
    """The backtest window: ``test_days``, or max(7, n // 5) for series with
    at most test_days + 30 points."""
    if n <= test_days + BACKTEST_SLACK_DAYS:
        return max(BACKTEST_MIN_DAYS, n // BACKTEST_DIVISOR)
    return test_days


def _forecast_batch(
    horizon: int, test_days: int, min_history: int, season: int, end_day: int | None
):
    def run(g: pd.DataFrame) -> dict[str, np.ndarray]:
        series = [s for s in _dense(g, end_day) if len(s[2]) >= min_history]
        if not series:
            return {c: [] for c in ROWS_SCHEMA_COLUMNS}
        pids = np.array([p for p, _, _ in series], dtype=np.int64)
        starts = np.array([d for _, d, _ in series], dtype="datetime64[D]")
        ns = np.array([len(y) for _, _, y in series])
        tds = np.array([backtest_days(int(n), test_days) for n in ns])
        # Two independent fits: one without the test days, one on everything.
        tfit, ffit = fit_twice([y for _, _, y in series], tds, season)
        bt = tfit.forecast(int(tds.max()))
        fc = ffit.forecast(horizon)
        k = len(series)
        # backtest rows: the last td days of each series
        b_step = np.concatenate([np.arange(1, td + 1) for td in tds])
        b_idx = np.repeat(np.arange(k), tds)
        b_off = (ns - tds - 1)[b_idx] + b_step
        b_actual = np.concatenate([y[len(y) - td:] for (_, _, y), td in zip(series, tds)])
        b_yhat = bt[b_idx, b_step - 1]
        # forecast rows: horizon days after each series' last day
        f_step = np.tile(np.arange(1, horizon + 1), k)
        f_idx = np.repeat(np.arange(k), horizon)
        f_off = (ns - 1)[f_idx] + f_step
        nb, nf = len(b_step), len(f_step)
        return {
            "product_id": np.concatenate([pids[b_idx], pids[f_idx]]),
            "kind": np.array(["backtest"] * nb + ["forecast"] * nf, dtype=object),
            "step": np.concatenate([b_step, f_step]).astype("int32"),
            "ds": np.concatenate([starts[b_idx] + b_off, starts[f_idx] + f_off]),
            "actual": np.concatenate([b_actual, np.full(nf, np.nan)]),
            "yhat": np.concatenate([b_yhat, fc.reshape(-1)]),
            "sigma": np.concatenate([np.full(nb, np.nan), ffit.sigma[f_idx]]),
        }

    return run


def forecast_rows(
    df: DataFrame,
    ids: DataFrame | None = None,
    horizon_days: int = 30,
    test_days: int = 30,
    min_history_days: int = MIN_HISTORY_DAYS,
    seasonal_periods: int = SEASON,
    align_end: date | None = None,
) -> DataFrame:
    """F3/F5/F6 core: backtest and forecast rows for every product (or the
    given ids) with at least ``min_history_days`` days of history.

    Columns: product_id, kind ('backtest' | 'forecast'), step (1-based), ds,
    actual (backtest only), yhat (unclipped), sigma (forecast only).

    Each series runs from the product's first to its last sale, so forecast
    dates differ by product; ``align_end`` extends every series with zero
    days up to a common date, so all forecasts start the day after it.
    """
    if test_days < 1:
        raise ValueError("test_days must be >= 1")
    if horizon_days < 1:
        raise ValueError("horizon_days must be >= 1")
    return forecast_rows_from(
        daily_sales(df, ids), horizon_days, test_days, min_history_days, seasonal_periods, align_end
    )


def forecast_rows_from(
    daily: DataFrame,
    horizon_days: int = 30,
    test_days: int = 30,
    min_history_days: int = MIN_HISTORY_DAYS,
    seasonal_periods: int = SEASON,
    align_end: date | None = None,
) -> DataFrame:
    """``forecast_rows`` over ``daily_sales`` that other branches may share."""
    end_day = None if align_end is None else (align_end - date(1970, 1, 1)).days
    run = _forecast_batch(horizon_days, test_days, min_history_days, seasonal_periods, end_day)
    return _per_batch(daily, run, ROWS_SCHEMA, end_day)


def mean_forecast_rows(
    daily: DataFrame,
    horizon_days: int = 14,
    test_days: int = 14,
    window_days: int = 28,
    min_history_days: int = MIN_HISTORY_DAYS,
) -> DataFrame:
    """The rows of ``forecast_rows`` by a model any SQL engine can repeat: the
    mean of the last ``window_days`` dense days, σ their population deviation;
    the backtest predicts the last ``test_days`` days from the window before
    them. Native expressions only; days without a sale count as zeros without
    being made into rows.
    """
    if test_days + window_days > min_history_days:
        raise ValueError("test_days + window_days must not exceed min_history_days")
    back = F.datediff("hi", "ds")
    spans = daily.groupBy("product_id").agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    long = spans.filter(F.datediff("hi", "lo") + 1 >= min_history_days).select("product_id", "hi")
    near = daily.join(long, "product_id").withColumn("back", back)

    def within(lo: int, hi: int, value):
        return F.coalesce(F.sum(F.when(F.col("back").between(lo, hi), value)), F.lit(0)).cast("double")

    y = F.col("y")
    last, train = (0, window_days - 1), (test_days, test_days + window_days - 1)
    per = near.filter(F.col("back") < test_days + window_days).groupBy("product_id", "hi").agg(
        within(*last, y).alias("s"),
        within(*last, y * y).alias("q"),
        within(*train, y).alias("s_train"),
        F.map_from_entries(
            F.collect_list(F.when(F.col("back") < test_days, F.struct("back", "y")))
        ).alias("tested"),
    )
    n = F.lit(float(window_days))
    tests = per.select(
        "product_id",
        F.lit("backtest").alias("kind"),
        F.explode(F.sequence(F.lit(1), F.lit(test_days))).alias("step"),
        "hi", "tested", "s_train",
    ).select(
        "product_id", "kind", "step",
        F.date_add("hi", F.col("step") - test_days).alias("ds"),
        F.coalesce(F.col("tested")[test_days - F.col("step")], F.lit(0)).cast("double").alias("actual"),
        (F.col("s_train") / n).alias("yhat"),
        F.lit(None).cast("double").alias("sigma"),
    )
    ahead = per.select(
        "product_id",
        F.lit("forecast").alias("kind"),
        F.explode(F.sequence(F.lit(1), F.lit(horizon_days))).alias("step"),
        "hi", "s", "q",
    ).select(
        "product_id", "kind", "step",
        F.date_add("hi", F.col("step")).alias("ds"),
        F.lit(None).cast("double").alias("actual"),
        (F.col("s") / n).alias("yhat"),
        (F.sqrt(n * F.col("q") - F.col("s") * F.col("s")) / n).alias("sigma"),
    )
    return tests.unionByName(ahead)


def forecast_many(
    df: DataFrame,
    ids: DataFrame | None = None,
    horizon_days: int = 30,
    products: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(forecast frame, backtest frame) for every product in ``ids``
    (all products when None) with enough history, default backtest window
    and 95 % band. The fitted rows are persisted so the two frames share one
    run of the grouped UDF, until ``session.release()``."""
    rows = hold(forecast_rows(df, ids, horizon_days, 30))
    return forecasts(rows, products, 0.95), backtest(rows, products)


def forecast_product(
    df: DataFrame,
    product_id: int,
    products: DataFrame | None = None,
    horizon_days: int = 30,
    test_days: int = 30,
    ci: float = 0.95,
) -> tuple[DataFrame, DataFrame]:
    """F5 for one product: (forecast frame, backtest frame); both empty when
    the product has under 60 days of history. The product filter is pushed
    into the scan."""
    rows = forecast_rows(df.filter(F.col("product_id") == F.lit(product_id)), None,
                         horizon_days, test_days)
    return forecasts(rows, products, ci), backtest(rows, products)


def band_z(ci: float) -> float:
    return Z_HIGH if ci >= 0.95 else Z_LOW


def forecasts(rows: DataFrame, products: DataFrame | None = None, ci: float = 0.95) -> DataFrame:
    """F5/F6 forecast frame: product_id, sku, ds, yhat, yhat_lower,
    yhat_upper (band ŷ ± z·σ, flat over the horizon; each clipped at 0),
    plus step and the unclipped residual σ (clipping narrows the band near
    zero, so σ recovered from the band is smaller than the fitted one)."""
    z = F.lit(band_z(ci))
    out = rows.filter(F.col("kind") == "forecast").select(
        "product_id",
        "ds",
        "step",
        F.greatest(F.col("yhat"), F.lit(0.0)).alias("yhat"),
        F.greatest(F.col("yhat") - z * F.col("sigma"), F.lit(0.0)).alias("yhat_lower"),
        F.greatest(F.col("yhat") + z * F.col("sigma"), F.lit(0.0)).alias("yhat_upper"),
        "sigma",
    )
    if products is not None:
        out = out.join(products.select("product_id", "sku"), "product_id", "left")
    else:
        out = out.withColumn("sku", F.lit(None).cast("string"))
    return out.select(
        "product_id", "sku", "ds", "yhat", "yhat_lower", "yhat_upper", "step", "sigma"
    )


def forecast_accuracy(
    df: DataFrame, actual: str = "actual", predicted: str = "yhat", keys=("product_id",)
) -> DataFrame:
    """per key, mape = mean(|a − p| / d)·100 with d = |a|, or 1 where
    |a| < 1e-9; rmse = sqrt(mean((a − p)²))."""
    a, p = F.col(actual), F.col(predicted)
    return df.groupBy(*keys).agg(
        percentage_error(a, p).alias("mape"), F.sqrt(F.avg((a - p) * (a - p))).alias("rmse")
    )


def percentage_error(a, p):
    """mape as an aggregate; rows where either is null do not count."""
    denom = F.when(F.abs(a) < F.lit(1e-9), F.lit(1.0)).otherwise(F.abs(a))
    return F.avg(F.abs(a - p) / denom) * F.lit(100.0)


def backtest(rows: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Backtest frame: product_id, sku, mape, rmse."""
    acc = forecast_accuracy(rows.filter(F.col("kind") == "backtest"))
    if products is not None:
        acc = acc.join(products.select("product_id", "sku"), "product_id", "left")
    else:
        acc = acc.withColumn("sku", F.lit(None).cast("string"))
    return acc.select("product_id", "sku", "mape", "rmse")


def history_and_forecast(history: DataFrame, forecast: DataFrame) -> DataFrame:
    """A3: (product_id, date, units, series) — history and forecast layers in
    one frame."""
    h = history.select(
        "product_id", F.col("ds").alias("date"), F.col("y").cast("double").alias("units"),
        F.lit("history").alias("series"),
    )
    f = forecast.select(
        "product_id", F.col("ds").alias("date"), F.col("yhat").alias("units"),
        F.lit("forecast").alias("series"),
    )
    return h.unionByName(f)


# ----------------------------------------------------------- fixed parameters

FIXED_SCHEMA = "product_id long, t int, ds date, y double, fitted double"


def _fixed_batch(alpha: float, beta: float, gamma: float):
    def run(g: pd.DataFrame) -> dict[str, np.ndarray]:
        series = _dense(g)
        if not series:
            return {c: [] for c in ["product_id", "t", "ds", "y", "fitted"]}
        fitted, _ = run_fixed([y for _, _, y in series], alpha, beta, gamma, SEASON)
        ns = np.array([len(y) for _, _, y in series])
        idx = np.repeat(np.arange(len(series)), ns)
        t = np.concatenate([np.arange(n) for n in ns])
        starts = np.array([d for _, d, _ in series], dtype="datetime64[D]")
        return {
            "product_id": np.array([p for p, _, _ in series], dtype=np.int64)[idx],
            "t": t.astype("int32"),
            "ds": starts[idx] + t,
            "y": np.concatenate([y for _, _, y in series]),
            "fitted": fitted[idx, t],
        }

    return run


def fixed_parameter_fit(
    df: DataFrame, alpha: float = 0.3, beta: float = 0.05, gamma: float = 0.1,
    ids: DataFrame | None = None,
) -> DataFrame:
    """F3 with given α, β, γ: the one-step fitted value of every day of every
    product's dense series (product_id, t, ds, y, fitted)."""
    return _per_batch(daily_sales(df, ids), _fixed_batch(alpha, beta, gamma), FIXED_SCHEMA)


STATE_SCHEMA = (
    "product_id long, days int, level double, trend double, sse double, sigma double, demand double"
)
GRID_SCHEMA = f"{STATE_SCHEMA}, alpha double, beta double, gamma double"


def _states(fit_of, horizon_days: int, schema: str):
    """A batch function: one row per product with the fit's end state."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(g: pd.DataFrame) -> dict[str, np.ndarray]:
        series = _dense(g)
        if not series:
            return {c: [] for c in columns}
        fit = fit_of([y for _, _, y in series])
        out = {
            "product_id": np.array([p for p, _, _ in series], dtype=np.int64), "days": fit.n.astype("int32"),
            "level": fit.level, "trend": fit.trend, "sse": fit.sse, "sigma": fit.sigma,
            "demand": fit.forecast(horizon_days).sum(axis=1),
            "alpha": fit.alpha, "beta": fit.beta, "gamma": fit.gamma,
        }
        return {c: out[c] for c in columns}

    return run


def fixed_parameter_state(
    df: DataFrame, alpha: float = 0.3, beta: float = 0.05, gamma: float = 0.1,
    horizon_days: int = 14, ids: DataFrame | None = None,
) -> DataFrame:
    """F3 with given α, β, γ: one row per product, the state after its last
    day, the sum of squared one-step errors, their population deviation (G9)
    and the demand ahead (unclipped)."""

    def fit(series):
        return run_fixed(series, alpha, beta, gamma, SEASON)[1]

    return _per_batch(daily_sales(df, ids), _states(fit, horizon_days, STATE_SCHEMA), STATE_SCHEMA)


def grid_fit_state(df: DataFrame, horizon_days: int = 14, ids: DataFrame | None = None) -> DataFrame:
    """F3 in the form any SQL engine can repeat: per product the cell of the
    fixed grid of (α, β, γ) with the least squared error, and the state that it
    ends in, as in ``fixed_parameter_state``."""
    return _per_batch(daily_sales(df, ids), _states(grid_fit, horizon_days, GRID_SCHEMA), GRID_SCHEMA)


__all__ = [
    "top_skus_by_revenue", "top_skus_with_labels", "daily_sales", "daily_units", "densify",
    "forecast_rows", "forecast_rows_from", "mean_forecast_rows", "forecast_many", "forecast_product",
    "forecasts", "backtest", "forecast_accuracy", "history_and_forecast",
    "fixed_parameter_fit", "fixed_parameter_state", "grid_fit_state", "product_batches",
]
