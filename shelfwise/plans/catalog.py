"""Query catalogue: name → ``(spark, sf_dir) -> DataFrame`` and its oracle SQL.

Every query reads the whole test tables through the adapter in
``sources.tpch``; nothing is sub-setted. Where a query has an ANSI-SQL
equivalent, its DuckDB text is registered next to it; column names match the
Spark result one to one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.holtwinters import GRID as HW_GRID
from shelfwise.operators import cohort as C
from shelfwise.operators import descriptive as D
from shelfwise.operators import forecast as FC
from shelfwise.operators import invoices as I
from shelfwise.operators import prescriptive as X
from shelfwise.operators import quality as Q
from shelfwise.operators import rfm as R
from shelfwise.plans.oracle import (
    COHORT,
    CUST,
    DAILY,
    EVENTS,
    PROD,
    RFM,
    TIER_SUMMARY,
    TOP_SKUS,
    TX,
    at_risk_cte,
    cohort_pivot_sql,
    with_ctes,
)
from shelfwise.session import checkpoint_dir
from shelfwise.sources import enrich, load_customers, load_products, load_transactions, tpch
from shelfwise.sources.schemas import TRANSACTIONS_SCHEMA
from shelfwise.sources.sinks import write_transactions

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name!r}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return register


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Doubles that depend on the order of summation, rounded for comparison
    with the oracle, whose SQL rounds alike."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---------------------------------------------------------------- descriptive

@query(
    "dataset_summary",
    with_ctes(TX)
    + """SELECT count(*) AS rows,
       count(DISTINCT customer_id) AS customers,
       count(DISTINCT product_id) AS products,
       count(DISTINCT invoice_id) AS orders,
       CAST(coalesce(sum(net_revenue), 0) AS DOUBLE) AS gross_revenue,
       CAST(coalesce(sum(profit), 0) AS DOUBLE) AS gross_profit,
       min(purchase_date) AS first_day,
       max(purchase_date) AS last_day
FROM tx""",
)
def q_dataset_summary(spark, sf_dir):
    return D.dataset_summary(tpch.transactions(spark, sf_dir))


def _time_sql(bucket_expr: str) -> str:
    return with_ctes(TX) + f"""SELECT {bucket_expr} AS bucket,
       CAST(coalesce(sum(net_revenue), 0) AS DOUBLE) AS revenue,
       CAST(coalesce(sum(profit), 0) AS DOUBLE) AS profit,
       count(DISTINCT invoice_id) AS orders,
       count(DISTINCT customer_id) AS customers,
       CAST(coalesce(sum(quantity), 0) AS BIGINT) AS units
FROM tx GROUP BY 1 ORDER BY 1"""


@query("revenue_day", _time_sql("purchase_date"))
def q_revenue_day(spark, sf_dir):
    return D.revenue_over_time(tpch.transactions(spark, sf_dir), "day")


@query("revenue_week", _time_sql("CAST(date_trunc('week', purchase_date) AS DATE)"))
def q_revenue_week(spark, sf_dir):
    return D.revenue_over_time(tpch.transactions(spark, sf_dir), "week")


@query("revenue_month", _time_sql("month_start"))
def q_revenue_month(spark, sf_dir):
    return D.revenue_over_time(tpch.transactions(spark, sf_dir), "month")


@query(
    "rolling_revenue_7",
    with_ctes(TX)
    + """, b AS (
  SELECT purchase_date AS bucket, coalesce(sum(net_revenue), 0) AS revenue_x, coalesce(sum(profit), 0) AS profit_x,
         count(DISTINCT invoice_id) AS orders, count(DISTINCT customer_id) AS customers,
         CAST(coalesce(sum(quantity), 0) AS BIGINT) AS units
  FROM tx GROUP BY 1
)
SELECT bucket, CAST(revenue_x AS DOUBLE) AS revenue, CAST(profit_x AS DOUBLE) AS profit,
       orders, customers, units,
       CAST(sum(revenue_x) OVER w AS DOUBLE) / count(*) OVER w AS revenue_ma_7
FROM b
WINDOW w AS (ORDER BY bucket ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
ORDER BY bucket""",
)
def q_rolling_revenue_7(spark, sf_dir):
    return D.rolling_revenue(tpch.transactions(spark, sf_dir), 7, "day")


@query(
    "revenue_by_category",
    with_ctes(TX, PROD)
    + """, g AS (
  SELECT category, coalesce(sum(net_revenue), 0) AS revenue_x, coalesce(sum(profit), 0) AS profit_x,
         CAST(coalesce(sum(quantity), 0) AS BIGINT) AS units, count(DISTINCT invoice_id) AS orders
  FROM tx LEFT JOIN prod USING (product_id) GROUP BY category
)
SELECT category, CAST(revenue_x AS DOUBLE) AS revenue, CAST(profit_x AS DOUBLE) AS profit,
       units, orders,
       CAST(revenue_x AS DOUBLE) / NULLIF(CAST(sum(revenue_x) OVER () AS DOUBLE), 0)
         AS revenue_share,
       CAST(profit_x AS DOUBLE) / NULLIF(CAST(revenue_x AS DOUBLE), 0) AS profit_margin
FROM g ORDER BY revenue DESC""",
)
def q_revenue_by_category(spark, sf_dir):
    t = tpch.retail_tables(spark, sf_dir, by_order=True)
    return D.revenue_by_category(enrich(t.transactions, products=t.products))


@query(
    "revenue_by_country",
    with_ctes(TX, CUST)
    + """SELECT country, CAST(coalesce(sum(net_revenue), 0) AS DOUBLE) AS revenue,
       CAST(coalesce(sum(profit), 0) AS DOUBLE) AS profit, count(DISTINCT customer_id) AS customers
FROM tx LEFT JOIN cust USING (customer_id) GROUP BY country ORDER BY revenue DESC""",
)
def q_revenue_by_country(spark, sf_dir):
    t = tpch.retail_tables(spark, sf_dir)
    return D.revenue_by_country(t.transactions, t.customers)


@query(
    "weekday_hour_heatmap",
    with_ctes(EVENTS)
    + """SELECT weekday, hour, CAST(coalesce(sum(net_revenue), 0) AS DOUBLE) AS revenue,
       count(*) AS transactions
FROM ev GROUP BY weekday, hour ORDER BY weekday, hour""",
)
def q_weekday_hour_heatmap(spark, sf_dir):
    return D.weekday_hour_heatmap(tpch.events_as_sales(spark, sf_dir))


@query(
    "top_products",
    with_ctes(TX, PROD)
    + """SELECT product_id, sku, category, CAST(coalesce(sum(net_revenue), 0) AS DOUBLE) AS revenue,
       CAST(coalesce(sum(profit), 0) AS DOUBLE) AS profit, CAST(coalesce(sum(quantity), 0) AS BIGINT) AS units
FROM tx LEFT JOIN prod USING (product_id)
GROUP BY product_id, sku, category
ORDER BY revenue DESC, product_id LIMIT 20""",
)
def q_top_products(spark, sf_dir):
    t = tpch.retail_tables(spark, sf_dir)
    return D.top_products(t.transactions, 20, t.products)


@query(
    "category_join_rollup",
    with_ctes(TX, PROD)
    + """SELECT category, CAST(coalesce(sum(net_revenue), 0) AS DOUBLE) AS rev,
       CAST(coalesce(sum(profit), 0) AS DOUBLE) AS profit, count(DISTINCT invoice_id) AS orders
FROM tx JOIN prod USING (product_id) GROUP BY category ORDER BY rev DESC""",
)
def q_category_join_rollup(spark, sf_dir):
    t = tpch.retail_tables(spark, sf_dir, by_order=True)
    return D.category_join_rollup(t.transactions, t.products)


@query(
    "summary_margin",
    with_ctes(TX)
    + """SELECT CAST(coalesce(sum(net_revenue), 0) AS DOUBLE) AS gross_revenue,
       CAST(coalesce(sum(profit), 0) AS DOUBLE) AS gross_profit,
       round(CAST(coalesce(sum(profit), 0) AS DOUBLE)
             / NULLIF(CAST(coalesce(sum(net_revenue), 0) AS DOUBLE), 0) * 100.0, 9) AS margin_pct
FROM tx""",
)
def q_summary_margin(spark, sf_dir):
    """E19 on the KPI row."""
    got = D.summary_margin(D.dataset_summary(tpch.transactions(spark, sf_dir)))
    return rounded(got.select("gross_revenue", "gross_profit", "margin_pct"), 9, "margin_pct")


@query(
    "latest_lines",
    with_ctes(TX)
    + """SELECT purchase_date, invoice_id, product_id, quantity, CAST(net_revenue AS DOUBLE) AS net_revenue
FROM tx ORDER BY purchase_date DESC, invoice_id DESC, product_id DESC, quantity DESC, net_revenue DESC LIMIT 20""",
)
def q_latest_lines(spark, sf_dir):
    """The last 20 lines of the fact table in date order."""
    order = ["purchase_date", "invoice_id", "product_id", "quantity", "net_revenue"]
    lines = tpch.transactions(spark, sf_dir).select(*order)
    return D.preview(lines, 20, *order, last=True).withColumn(
        "net_revenue", F.col("net_revenue").cast("double")
    )


# ------------------------------------------------------------------------ RFM


def _rounded_tiers(df: DataFrame) -> DataFrame:
    return rounded(rounded(df, 2, "revenue"), 6, "avg_monetary", "revenue_share")


def _rfm(spark, sf_dir):
    return R.compute_rfm(tpch.transactions(spark, sf_dir, by_order=True))


@query("reference_date", with_ctes(TX) + "SELECT max(purchase_date) AS reference_date FROM tx")
def q_reference_date(spark, sf_dir):
    return R.reference_date(tpch.transactions(spark, sf_dir))


@query("rfm", with_ctes(TX, RFM) + "SELECT * FROM rfm ORDER BY customer_id")
def q_rfm(spark, sf_dir):
    return _rfm(spark, sf_dir)


@query("tier_summary", with_ctes(TX, RFM, TIER_SUMMARY) + "SELECT * FROM tsum")
def q_tier_summary(spark, sf_dir):
    return _rounded_tiers(R.tier_summary(_rfm(spark, sf_dir)))


@query("at_risk_customers", with_ctes(TX, RFM, at_risk_cte()) + "SELECT * FROM at_risk")
def q_at_risk_customers(spark, sf_dir):
    return R.at_risk_customers(_rfm(spark, sf_dir))


@query(
    "at_risk_revenue",
    with_ctes(TX, RFM, at_risk_cte())
    + """SELECT count(*) AS customers,
       round(CAST(coalesce(sum(CAST(monetary AS DECIMAL(38,4))), 0) AS DOUBLE), 2) AS dollars_at_risk,
       round(CAST(sum(CAST(monetary AS DECIMAL(38,4))) AS DOUBLE)
             / NULLIF(CAST(count(*) AS DOUBLE), 0), 6) AS avg_customer_value
FROM at_risk""",
)
def q_at_risk_revenue(spark, sf_dir):
    got = R.at_risk_revenue(R.at_risk_customers(_rfm(spark, sf_dir)))
    return rounded(rounded(got, 2, "dollars_at_risk"), 6, "avg_customer_value")


@query(
    "rfm_tier_lookup",
    with_ctes(TX, RFM, TIER_SUMMARY)
    + """SELECT t.tier_order, t.tier, coalesce(s.customers, 0) AS customers, s.revenue,
       s.avg_monetary, s.avg_frequency, s.avg_recency_days, s.revenue_share, s.customer_share
FROM (VALUES (0, 'Platinum'), (1, 'Gold'), (2, 'Silver'), (3, 'Bronze')) t(tier_order, tier)
LEFT JOIN tsum s USING (tier) ORDER BY t.tier_order""",
)
def q_rfm_tier_lookup(spark, sf_dir):
    return R.tier_lookup(_rounded_tiers(R.tier_summary(_rfm(spark, sf_dir))))


@query(
    "rfm_sample",
    with_ctes(TX, RFM)
    + """SELECT * FROM rfm
ORDER BY CAST(((((CAST(customer_id AS DECIMAL(38,0)) + 42) * 2654435761) % 4294967296)
               + 4294967296) % 4294967296 AS BIGINT),
         customer_id
LIMIT 5000""",
)
def q_rfm_sample(spark, sf_dir):
    return R.rfm_sample(_rfm(spark, sf_dir), 5000, 42)


# --------------------------------------------------------------------- cohort


@query(
    "first_purchase_month",
    with_ctes(TX)
    + """SELECT customer_id, min(month_start) AS cohort_month FROM tx
WHERE customer_id IS NOT NULL GROUP BY customer_id""",
)
def q_first_purchase_month(spark, sf_dir):
    return C.first_purchase_month(tpch.transactions(spark, sf_dir))


@query("cohort_matrix", with_ctes(TX, COHORT) + "SELECT * FROM cm ORDER BY 1, 4")
def q_cohort_matrix(spark, sf_dir):
    return C.monthly_cohort_matrix(tpch.transactions(spark, sf_dir))


@query("cohort_pivot", with_ctes(TX, COHORT) + cohort_pivot_sql(12))
def q_cohort_pivot(spark, sf_dir):
    return C.cohort_heatmap_pivot(C.monthly_cohort_matrix(tpch.transactions(spark, sf_dir)), 12)


@query(
    "retention_curve",
    with_ctes(TX, COHORT)
    + """SELECT months_since, round(avg(retention), 12) AS avg_retention
FROM cm WHERE months_since <= 12 GROUP BY months_since ORDER BY months_since""",
)
def q_retention_curve(spark, sf_dir):
    curve = C.average_retention_curve(
        C.monthly_cohort_matrix(tpch.transactions(spark, sf_dir)), 12
    )
    return rounded(curve, 12, "avg_retention")


# ------------------------------------------------------------------- forecast


@query("top_skus", with_ctes(TX, TOP_SKUS) + "SELECT product_id FROM top")
def q_top_skus(spark, sf_dir):
    return FC.top_skus_by_revenue(tpch.transactions(spark, sf_dir), 50)


@query(
    "top_skus_labels",
    with_ctes(TX, PROD, TOP_SKUS)
    + """SELECT DISTINCT product_id, sku FROM tx LEFT JOIN prod USING (product_id)
WHERE product_id IN (SELECT product_id FROM top)""",
)
def q_top_skus_labels(spark, sf_dir):
    t = tpch.retail_tables(spark, sf_dir)
    return FC.top_skus_with_labels(t.transactions, t.products, 50)


@query("daily_units", with_ctes(TX, DAILY) + "SELECT product_id, ds, y FROM dense")
def q_daily_units(spark, sf_dir):
    return FC.daily_units(tpch.transactions(spark, sf_dir))


@query(
    "forecast_accuracy",
    with_ctes(TX, DAILY)
    + """, pairs AS (
  SELECT product_id, CAST(y AS DOUBLE) AS actual,
         CAST(lag(y, 7) OVER (PARTITION BY product_id ORDER BY ds) AS DOUBLE) AS predicted
  FROM dense
)
SELECT product_id,
       round(avg(abs(actual - predicted)
                 / CASE WHEN abs(actual) < 1e-9 THEN 1.0 ELSE abs(actual) END) * 100.0, 6) AS mape,
       round(sqrt(avg((actual - predicted) * (actual - predicted))), 6) AS rmse
FROM pairs WHERE predicted IS NOT NULL GROUP BY product_id""",
)
def q_forecast_accuracy(spark, sf_dir):
    """F4 scored on a prediction both engines can reproduce: each day's
    units against the units 7 days earlier on the dense series."""
    pairs = FC.daily_units(tpch.transactions(spark, sf_dir), lag_days=7).select(
        "product_id",
        F.col("y").cast("double").alias("actual"),
        F.col("y_lag").cast("double").alias("predicted"),
    ).filter(F.col("predicted").isNotNull())
    return rounded(FC.forecast_accuracy(pairs, "actual", "predicted"), 6, "mape", "rmse")


@query("hw_fixed_params")
def q_hw_fixed_params(spark, sf_dir):
    return FC.fixed_parameter_fit(tpch.transactions(spark, sf_dir), 0.3, 0.05, 0.1)


# The recursion as a fold over each product's list of days: the state is level,
# trend, the seven seasonal values (the next day's first), the squared errors and
# the errors. {cells} names the parameters; a list element carries γ, αβ and α.
HW_FOLD = """, lists AS (
  SELECT product_id, list(CAST(y AS DOUBLE) ORDER BY ds) AS ys FROM dense GROUP BY 1
), start AS (
  SELECT *, len(ys) AS n, len(ys) >= 14 AS seasonal, list_sum(ys[1:7]) / 7 AS first,
         (list_sum(ys[8:14]) / 7 - list_sum(ys[1:7]) / 7) / 7 AS slope FROM lists
), cells AS (
  SELECT * FROM (VALUES {cells}) AS c(cell, alpha, beta, gamma)
), init AS (
  SELECT product_id, ys, n, cell, alpha, beta, CASE WHEN seasonal THEN gamma ELSE 0 END AS gamma,
         CASE WHEN seasonal THEN {{'l': first - slope * 4, 'b': slope,
                's': [ys[i + 1] - (first + slope * (i - 3)) FOR i IN range(7)], 'q': 0.0::DOUBLE, 'y': 0.0::DOUBLE}}
              ELSE {{'l': ys[1] - (CASE WHEN n > 1 THEN ys[2] - ys[1] ELSE 0 END),
                'b': CASE WHEN n > 1 THEN ys[2] - ys[1] ELSE 0 END,
                's': [0.0::DOUBLE FOR i IN range(7)], 'q': 0.0::DOUBLE, 'y': 0.0::DOUBLE}} END AS st
  FROM start, cells
), fold AS (
  SELECT product_id, n, cell, alpha, beta, gamma, list_reduce(
    [{{'l': gamma, 'b': alpha * beta, 's': []::DOUBLE[], 'q': alpha, 'y': v}} FOR v IN ys],
    lambda a, x: {{
      'l': x.q * ((x.y - (a.l + a.b)) - a.s[1]) + (a.l + a.b),
      'b': a.b + x.b * ((x.y - (a.l + a.b)) - a.s[1]),
      's': list_append(a.s[2:7], a.s[1] + x.l * ((x.y - (a.l + a.b)) - a.s[1])),
      'q': a.q + ((x.y - (a.l + a.b)) - a.s[1]) * ((x.y - (a.l + a.b)) - a.s[1]),
      'y': a.y + ((x.y - (a.l + a.b)) - a.s[1])}},
    st) AS f
  FROM init
), best AS (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY f.q, cell) AS place FROM fold
)
SELECT product_id, CAST(n AS INTEGER) AS days, round(f.l, 6) AS level, round(f.b, 6) AS trend,
       round(f.q, 3) AS sse, round(sqrt(greatest(f.q / n - (f.y / n) * (f.y / n), 0)), 6) AS sigma,
       round(14 * f.l + 105 * f.b + 2 * list_sum(f.s), 6) AS demand{more}
FROM best WHERE place = 1"""


def hw_fold(cells, more: str = "") -> str:
    values = ", ".join(
        f"({i}, {a}::DOUBLE, {b}::DOUBLE, {g}::DOUBLE)" for i, (a, b, g) in enumerate(cells)
    )
    return with_ctes(TX, DAILY) + HW_FOLD.format(cells=values, more=more)


@query("hw_fixed_state", hw_fold([(0.3, 0.05, 0.1)]))
def q_hw_fixed_state(spark, sf_dir):
    """the state each product's recursion ends in, σ, and what lies ahead."""
    got = FC.fixed_parameter_state(tpch.transactions(spark, sf_dir), 0.3, 0.05, 0.1, 14)
    return rounded(rounded(got, 6, "level", "trend", "sigma", "demand"), 3, "sse")


@query("hw_grid_fit", hw_fold(HW_GRID, ",\n       alpha, beta, gamma"))
def q_hw_grid_fit(spark, sf_dir):
    """each product's best cell of the fixed grid and the state it ends in."""
    got = FC.grid_fit_state(tpch.transactions(spark, sf_dir), 14)
    return rounded(rounded(got, 6, "level", "trend", "sigma", "demand"), 3, "sse")


def _forecast_rows(spark, sf_dir, horizon=30):
    return FC.forecast_rows(tpch.transactions(spark, sf_dir), None, horizon, 30)


@query("forecast_many")
def q_forecast_many(spark, sf_dir):
    return FC.forecasts(_forecast_rows(spark, sf_dir), tpch.products(spark, sf_dir))


@query("forecast_backtest")
def q_forecast_backtest(spark, sf_dir):
    return FC.backtest(_forecast_rows(spark, sf_dir), tpch.products(spark, sf_dir))


@query("history_and_forecast")
def q_history_and_forecast(spark, sf_dir):
    daily = FC.daily_sales(tpch.transactions(spark, sf_dir))
    fc = FC.forecasts(FC.forecast_rows_from(daily, 30, 30))
    return FC.history_and_forecast(FC.densify(daily), fc)


# ---------------------------------------------------------- sink and loaders


@query(
    "sink_round_trip",
    with_ctes(TX)
    + """SELECT count(*) AS rows,
       count(DISTINCT customer_id) AS customers,
       count(DISTINCT product_id) AS products,
       count(DISTINCT invoice_id) AS orders,
       CAST(coalesce(sum(net_revenue), 0) AS DOUBLE) AS gross_revenue,
       CAST(coalesce(sum(profit), 0) AS DOUBLE) AS gross_profit,
       min(purchase_date) AS first_day,
       max(purchase_date) AS last_day,
       (SELECT count(*) FROM customer) AS customer_rows,
       (SELECT count(*) FROM part) AS product_rows,
       count(*) FILTER (WHERE year(purchase_date) = 1996 AND month(purchase_date) = 3) AS month_rows,
       true AS skips_files
FROM tx""",
)
def q_sink_round_trip(spark, sf_dir):
    """The tables written by the sink and read back by the loaders;
    the rows of one month must lie in fewer files than were written."""
    folder = f"{checkpoint_dir(spark)}/round-trip-{uuid.uuid4().hex}"
    tx = tpch.transactions(spark, sf_dir)
    write_transactions(tx.select(*TRANSACTIONS_SCHEMA.names), f"{folder}/transactions", 24)
    tpch.customers(spark, sf_dir).write.parquet(f"{folder}/customers")
    tpch.products(spark, sf_dir).write.parquet(f"{folder}/products")
    back = load_transactions(spark, f"{folder}/transactions")
    first, last = (F.lit(t).cast("timestamp_ntz") for t in ("1996-03-01 00:00:00", "1996-03-31 23:59:59"))
    month = back.filter(F.col("purchase_ts").between(first, last)).agg(
        F.count("*").alias("rows"), F.count_distinct("_metadata.file_path").alias("files")
    ).first()
    return D.dataset_summary(back).withColumns(
        {
            "customer_rows": F.lit(load_customers(spark, f"{folder}/customers").count()).cast("long"),
            "product_rows": F.lit(load_products(spark, f"{folder}/products").count()).cast("long"),
            "month_rows": F.lit(month.rows).cast("long"),
            "skips_files": F.lit(month.files < len(back.inputFiles())),
        }
    )


# --------------------------------------------------------------- prescriptive


def _reorder(spark, sf_dir, lead_time=14):
    """Forecast horizon = lead time, as the reorder screen does."""
    rows = FC.forecast_rows(tpch.transactions(spark, sf_dir), None, lead_time, 30)
    return X.reorder_from_rows(rows, tpch.products(spark, sf_dir), lead_time, 1.65)


@query("reorder_report")
def q_reorder_report(spark, sf_dir):
    return _reorder(spark, sf_dir)


@query("status_counts")
def q_status_counts(spark, sf_dir):
    return X.status_counts(_reorder(spark, sf_dir))


@query("flag_status")
def q_flag_status(spark, sf_dir):
    return X.flag_status(_reorder(spark, sf_dir))


# The same operators over a forecast that SQL can repeat (28-day means).

MEAN_DAYS, MEAN_TEST, MEAN_AHEAD = 28, 14, 14
MEAN_SQL = with_ctes(TX, PROD, DAILY) + f""", span AS (
  SELECT product_id, min(ds) AS lo, max(ds) AS hi FROM d GROUP BY 1
  HAVING date_diff('day', min(ds), max(ds)) + 1 >= 60
), near AS (
  SELECT product_id, hi, y, CAST(date_diff('day', ds, hi) AS INTEGER) AS back FROM d JOIN span USING (product_id)
), per AS (
  SELECT product_id, hi,
         CAST(coalesce(sum(y) FILTER (WHERE back < {MEAN_DAYS}), 0) AS DOUBLE) AS s,
         CAST(coalesce(sum(y * y) FILTER (WHERE back < {MEAN_DAYS}), 0) AS DOUBLE) AS q,
         CAST(coalesce(sum(y) FILTER (WHERE back >= {MEAN_TEST} AND back < {MEAN_TEST + MEAN_DAYS}), 0)
              AS DOUBLE) AS s_train
  FROM near GROUP BY 1, 2
), fc AS (
  SELECT product_id, step, CAST(hi + CAST(step AS INTEGER) AS DATE) AS ds, s / {MEAN_DAYS} AS yhat,
         sqrt({MEAN_DAYS} * q - s * s) / {MEAN_DAYS} AS sigma
  FROM per, range(1, {MEAN_AHEAD + 1}) t(step)
), bands AS (
  SELECT *, greatest(yhat - 1.96 * sigma, 0) AS yhat_lower, yhat + 1.96 * sigma AS yhat_upper FROM fc
), bt AS (
  SELECT p.product_id, CAST(coalesce(n.y, 0) AS DOUBLE) AS a, p.s_train / {MEAN_DAYS} AS f
  FROM (SELECT * FROM per, range(0, {MEAN_TEST}) t(back)) p
  LEFT JOIN near n ON n.product_id = p.product_id AND n.back = p.back
), acc AS (
  SELECT product_id, avg(abs(a - f) / CASE WHEN abs(a) < 1e-9 THEN 1.0 ELSE abs(a) END) * 100.0 AS mape,
         sqrt(avg((a - f) * (a - f))) AS rmse
  FROM bt GROUP BY 1
), dem AS (
  SELECT product_id, sum(yhat) AS expected_demand,
         1.65 * (avg(yhat_upper - yhat) / 1.96) * sqrt({MEAN_AHEAD}) AS safety_stock
  FROM bands GROUP BY 1
), rep AS (
  SELECT dem.product_id, prod.sku, round(expected_demand, 6) AS expected_demand,
         round(safety_stock, 6) AS safety_stock,
         round(expected_demand + safety_stock, 6) AS reorder_point, round(mape, 6) AS mape_pct,
         stock_on_hand, category, unit_price,
         CASE WHEN stock_on_hand < expected_demand - 1e-7 THEN 'red'
              WHEN stock_on_hand < expected_demand + safety_stock - 1e-7 THEN 'yellow'
              ELSE 'green' END AS status,
         round(expected_demand - stock_on_hand, 6) AS shortfall_units
  FROM dem LEFT JOIN acc USING (product_id) LEFT JOIN prod USING (product_id)
)
"""
REPORT_DOUBLES = ("expected_demand", "safety_stock", "reorder_point", "mape_pct", "shortfall_units")


def _mean_rows(spark, sf_dir):
    daily = FC.daily_sales(tpch.transactions(spark, sf_dir))
    return FC.mean_forecast_rows(daily, MEAN_AHEAD, MEAN_TEST, MEAN_DAYS)


def _mean_report(spark, sf_dir):
    return X.reorder_from_rows(
        _mean_rows(spark, sf_dir), tpch.products(spark, sf_dir), MEAN_AHEAD, 1.65
    )


@query("reorder_report_mean", MEAN_SQL + "SELECT * FROM rep")
def q_reorder_report_mean(spark, sf_dir):
    """X1 on the 28-day mean."""
    return rounded(_mean_report(spark, sf_dir), 6, *REPORT_DOUBLES)


@query(
    "status_counts_mean",
    MEAN_SQL
    + """SELECT status, count(rep.status) AS count
FROM (VALUES ('red'), ('yellow'), ('green')) t(status) LEFT JOIN rep USING (status) GROUP BY status""",
)
def q_status_counts_mean(spark, sf_dir):
    """A1 on the 28-day mean."""
    return X.status_counts(_mean_report(spark, sf_dir))


@query(
    "flag_status_mean",
    MEAN_SQL
    + """SELECT CASE status WHEN 'red' THEN '🔴' WHEN 'yellow' THEN '🟡' ELSE '🟢' END AS flag, sku, category,
       expected_demand, safety_stock, reorder_point, stock_on_hand, shortfall_units, mape_pct FROM rep""",
)
def q_flag_status_mean(spark, sf_dir):
    """A2 on the 28-day mean."""
    return rounded(X.flag_status(_mean_report(spark, sf_dir)), 6, *REPORT_DOUBLES)


@query(
    "forecast_product_mean",
    MEAN_SQL
    + """SELECT f.product_id, prod.sku, f.ds, round(yhat, 6) AS yhat,
       round(greatest(yhat - 1.28 * sigma, 0), 6) AS yhat_lower, round(yhat + 1.28 * sigma, 6) AS yhat_upper,
       CAST(step AS INTEGER) AS step, round(sigma, 6) AS sigma, round(mape, 6) AS mape, round(rmse, 6) AS rmse
FROM fc f LEFT JOIN prod USING (product_id) LEFT JOIN acc ON acc.product_id = f.product_id""",
)
def q_forecast_product_mean(spark, sf_dir):
    """F5's two frames at an 80 % band and 14 test days, on the 28-day mean,
    for every product."""
    rows = _mean_rows(spark, sf_dir)
    got = FC.forecasts(rows, tpch.products(spark, sf_dir), 0.8).join(
        FC.backtest(rows).drop("sku"), "product_id", "left"
    )
    return rounded(got, 6, "yhat", "yhat_lower", "yhat_upper", "sigma", "mape", "rmse")


@query(
    "history_and_forecast_mean",
    MEAN_SQL
    + """SELECT product_id, ds AS date, CAST(y AS DOUBLE) AS units, 'history' AS series FROM dense
UNION ALL SELECT product_id, ds, round(yhat, 6), 'forecast' FROM fc""",
)
def q_history_and_forecast_mean(spark, sf_dir):
    """A3 on the 28-day mean."""
    daily = FC.daily_sales(tpch.transactions(spark, sf_dir))
    fc = FC.forecasts(FC.mean_forecast_rows(daily, MEAN_AHEAD, MEAN_TEST, MEAN_DAYS))
    # Units sold are whole numbers: only the forecast has digits to round.
    return FC.history_and_forecast(FC.densify(daily), rounded(fc, 6, "yhat"))


def _dead_sql(lookback: int, min_value: float) -> str:
    return with_ctes(TX, PROD) + f""", recent AS (
  SELECT product_id, CAST(coalesce(sum(quantity), 0) AS BIGINT) AS recent_units FROM tx
  WHERE purchase_date >= (SELECT max(purchase_date) FROM tx) - INTERVAL {lookback} DAY
  GROUP BY product_id
), dead AS (
  SELECT p.*, CAST(coalesce(r.recent_units, 0) AS BIGINT) AS recent_units,
         p.stock_on_hand * p.unit_price AS parked_value
  FROM prod p LEFT JOIN recent r USING (product_id)
  WHERE coalesce(r.recent_units, 0) = 0 AND p.stock_on_hand * p.unit_price >= {min_value}
)
"""


@query("dead_stock", _dead_sql(180, 100.0) + "SELECT * FROM dead ORDER BY parked_value DESC")
def q_dead_stock(spark, sf_dir):
    return X.dead_stock(tpch.transactions(spark, sf_dir), tpch.products(spark, sf_dir), 180)


@query(
    "dead_stock_total",
    _dead_sql(180, 100.0)
    + """SELECT round(CAST(coalesce(sum(CAST(parked_value AS DECIMAL(38,4))), 0) AS DOUBLE), 2)
         AS total_parked_value,
       count(*) AS products
FROM dead""",
)
def q_dead_stock_total(spark, sf_dir):
    total = X.dead_stock_total(
        X.dead_stock(tpch.transactions(spark, sf_dir), tpch.products(spark, sf_dir), 180)
    )
    return rounded(total, 2, "total_parked_value")


# --------------------------------------------------------------- data quality


@query(
    "dq_orphans",
    with_ctes(TX, CUST, PROD)
    + """SELECT (SELECT count(*) FROM tx WHERE NOT EXISTS
          (SELECT 1 FROM cust c WHERE c.customer_id = tx.customer_id)) AS orphan_customers,
       (SELECT count(*) FROM tx WHERE NOT EXISTS
          (SELECT 1 FROM prod p WHERE p.product_id = tx.product_id)) AS orphan_products""",
)
def q_dq_orphans(spark, sf_dir):
    t = tpch.retail_tables(spark, sf_dir)
    return Q.orphans(t.transactions, t.customers, t.products)


@query(
    "dq_pre_signup",
    with_ctes(TX, CUST)
    + """SELECT count(CASE WHEN purchase_date < signup_date THEN 1 END) AS pre_signup_rows
FROM tx JOIN cust USING (customer_id)""",
)
def q_dq_pre_signup(spark, sf_dir):
    t = tpch.retail_tables(spark, sf_dir)
    return Q.pre_signup(t.transactions, t.customers)


@query(
    "dq_positive",
    with_ctes(TX)
    + """SELECT count(CASE WHEN net_revenue <= 0 THEN 1 END) AS non_positive_revenue,
       count(CASE WHEN quantity < 1 THEN 1 END) AS quantity_below_one,
       CAST(min(net_revenue) AS DOUBLE) AS min_net_revenue,
       min(quantity) AS min_quantity
FROM tx""",
)
def q_dq_positive(spark, sf_dir):
    return Q.positive_measures(tpch.transactions(spark, sf_dir))


@query(
    "dq_bounds",
    with_ctes(TX)
    + """SELECT rows, target, lo, hi, rows >= lo AND rows <= hi AS within_bounds
FROM (SELECT (SELECT count(*) FROM tx) AS rows, t.target,
             CAST(floor(t.target * 0.75) AS BIGINT) AS lo,
             CAST(ceil(t.target * 1.25) AS BIGINT) AS hi
      FROM (SELECT CAST(4 * count(*) AS BIGINT) AS target FROM orders) t)""",
)
def q_dq_bounds(spark, sf_dir):
    """Row count within ±25 % of a target of four lines per order."""
    orders = spark.read.parquet(f"{sf_dir.rstrip('/')}/orders.parquet")
    target = orders.agg((F.count(F.lit(1)) * 4).alias("target"))
    return Q.row_bounds_near(tpch.transactions(spark, sf_dir), target, 0.25)


@query(
    "dq_unique_keys",
    with_ctes(CUST, PROD)
    + """SELECT 'customers' AS "table", CAST(coalesce(sum(n), 0) AS BIGINT) AS rows,
       count(customer_id) AS distinct_keys, count(CASE WHEN n > 1 THEN 1 END) AS duplicated_keys
FROM (SELECT customer_id, count(*) AS n FROM cust GROUP BY customer_id)
UNION ALL
SELECT 'products', CAST(coalesce(sum(n), 0) AS BIGINT), count(product_id),
       count(CASE WHEN n > 1 THEN 1 END)
FROM (SELECT product_id, count(*) AS n FROM prod GROUP BY product_id)""",
)
def q_dq_unique_keys(spark, sf_dir):
    t = tpch.retail_tables(spark, sf_dir)
    return Q.duplicate_keys(t.customers, "customer_id", "customers").unionByName(
        Q.duplicate_keys(t.products, "product_id", "products")
    )


@query(
    "dq_schema",
    with_ctes(CUST, PROD)
    + "".join(
        f"{'UNION ALL ' if i else ''}SELECT '{t}' AS \"table\", '{c}' AS \"column\", true AS ok,"
        f" count(*) - count({c}) AS nulls FROM {v} "
        for i, (t, v, c) in enumerate(
            [("customers", "cust", c) for c in ("customer_id", "signup_date", "country")]
            + [
                ("products", "prod", c)
                for c in ("product_id", "sku", "category", "unit_price", "margin_pct", "stock_on_hand")
            ]
        )
    ),
)
def q_dq_schema(spark, sf_dir):
    """Q5: every expected column of the dimensions, its type and its nulls."""
    frames = {"customers": tpch.customers(spark, sf_dir), "products": tpch.products(spark, sf_dir)}
    types = Q.schema_report(spark, frames).select("table", "column", "ok")
    nulls = None
    for name, df in frames.items():
        counted = df.agg(
            *(F.count(F.when(F.col(c).isNull(), F.lit(1))).alias(c) for c in df.columns)
        ).unpivot([F.lit(name).alias("table")], df.columns, "column", "nulls")
        nulls = counted if nulls is None else nulls.unionByName(counted)
    return types.join(nulls, ["table", "column"])


# ---------------------------------------------------------- invoices, measures

@query(
    "invoice_ids",
    with_ctes(TX)
    + """SELECT printf('INV-%08d', dense_rank() OVER (ORDER BY customer_id, purchase_date))
         AS invoice_id, customer_id, purchase_date, lines, units
FROM (SELECT customer_id, purchase_date, count(*) AS lines, CAST(coalesce(sum(quantity), 0) AS BIGINT) AS units
      FROM tx GROUP BY customer_id, purchase_date)""",
)
def q_invoice_ids(spark, sf_dir):
    """Invoices re-keyed as one per customer and day, with their line and
    unit counts."""
    tx = I.assign_invoice_ids(tpch.transactions(spark, sf_dir))
    return tx.groupBy("invoice_id", "customer_id", "purchase_date").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("quantity").cast("long").alias("units")
    )


@query(
    "line_measures",
    with_ctes(TX, PROD)
    + """SELECT invoice_id, product_id, quantity,
       tx.unit_price * quantity * (1 - discount_pct) AS net_revenue,
       tx.unit_price * quantity * (1 - discount_pct) * margin_pct AS profit
FROM tx LEFT JOIN prod USING (product_id)""",
)
def q_line_measures(spark, sf_dir):
    t = tpch.retail_tables(spark, sf_dir)
    base = t.transactions.select(
        "invoice_id", "product_id", "quantity", "unit_price", "discount_pct"
    ).join(t.products.select("product_id", "margin_pct"), "product_id", "left")
    return I.line_measures(base).select(
        "invoice_id", "product_id", "quantity", "net_revenue", "profit"
    )


# ------------------------------------------------------------------- enriched

@query(
    "enriched",
    with_ctes(TX, CUST, PROD)
    + """SELECT tx.invoice_id, tx.customer_id, tx.product_id, tx.purchase_ts, tx.quantity,
       tx.unit_price, tx.discount_pct, CAST(tx.net_revenue AS DOUBLE) AS net_revenue,
       CAST(tx.profit AS DOUBLE) AS profit, tx.purchase_date, tx.year, tx.month, tx.weekday,
       tx.hour, tx.month_start, c.signup_date, c.country, p.sku, p.category, p.margin_pct,
       p.stock_on_hand
FROM tx LEFT JOIN cust c USING (customer_id) LEFT JOIN prod p USING (product_id)""",
)
def q_enriched(spark, sf_dir):
    """I0 + S1: the canonical 21-column frame (money shown as double)."""
    t = tpch.retail_tables(spark, sf_dir)
    e = enrich(t.transactions, t.customers, t.products)
    return e.withColumns(
        {"net_revenue": F.col("net_revenue").cast("double"),
         "profit": F.col("profit").cast("double")}
    ).select(
        "invoice_id", "customer_id", "product_id", "purchase_ts", "quantity", "unit_price",
        "discount_pct", "net_revenue", "profit", "purchase_date", "year", "month", "weekday",
        "hour", "month_start", "signup_date", "country", "sku", "category", "margin_pct",
        "stock_on_hand",
    )
