"""DuckDB SQL building blocks mirroring the adapter in ``sources.tpch``.

Each query's oracle is plain SQL over the pre-registered tables (lineitem,
orders, customer, nation, part, events). The CTEs here restate the adapter's
column mapping so each oracle is self-contained.
"""

from __future__ import annotations

TX = """tx AS (
  SELECT printf('INV-%08d', l_orderkey) AS invoice_id,
         o_custkey AS customer_id,
         l_partkey AS product_id,
         CAST(o_orderdate AS TIMESTAMP) AS purchase_ts,
         CAST(o_orderdate AS DATE) AS purchase_date,
         CAST(year(o_orderdate) AS INTEGER) AS year,
         CAST(month(o_orderdate) AS INTEGER) AS month,
         CAST(isodow(o_orderdate) AS INTEGER) AS weekday,
         CAST(hour(o_orderdate) AS INTEGER) AS hour,
         CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start,
         CAST(l_quantity AS INTEGER) AS quantity,
         CASE WHEN l_quantity = 0 THEN NULL ELSE l_extendedprice / l_quantity END AS unit_price,
         l_discount AS discount_pct,
         CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
           AS net_revenue,
         CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
           * CAST((5 + (l_partkey * 37) % 71) * 0.01 AS DECIMAL(4,2)) AS profit
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""

CUST = """cust AS (
  SELECT c_custkey AS customer_id, CAST(DATE '1994-01-01' + CAST((c_custkey * 131) % 1500 AS INTEGER) AS DATE) AS signup_date, n_name AS country
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
)"""

PROD = """prod AS (
  SELECT p_partkey AS product_id,
         printf('SKU-%06d', p_partkey) AS sku,
         p_type AS category,
         p_retailprice AS unit_price,
         (5 + (p_partkey * 37) % 71) / 100.0 AS margin_pct,
         CAST(5 + (p_partkey * 7919) % 1995 AS BIGINT) AS stock_on_hand
  FROM part
)"""

EVENTS = """ev AS (
  SELECT printf('EVT-%08d', event_id) AS invoice_id,
         user_id AS customer_id,
         CAST(ts AS TIMESTAMP) AS purchase_ts,
         CAST(ts AS DATE) AS purchase_date,
         CAST(isodow(ts) AS INTEGER) AS weekday,
         CAST(hour(ts) AS INTEGER) AS hour,
         CAST(value AS DECIMAL(18,2)) AS net_revenue
  FROM events
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _qscore(col: str, q: str) -> str:
    return (f"(1 + CAST({col} > {q}[1] AS INTEGER) + CAST({col} > {q}[2] AS INTEGER)"
            f" + CAST({col} > {q}[3] AS INTEGER))")


# RFM over the adapter's transactions: per-customer base, reference date,
# linear quartile cut points, right-closed quartile scores, tiers.
RFM = f"""base AS (
  SELECT customer_id, count(DISTINCT invoice_id) AS frequency,
         CAST(coalesce(sum(net_revenue), 0) AS DOUBLE) AS monetary,
         min(purchase_date) AS first_purchase, max(purchase_date) AS last_purchase
  FROM tx GROUP BY customer_id
), rb AS (
  SELECT *, CAST(date_diff('day', last_purchase, (SELECT max(last_purchase) FROM base))
                 AS INTEGER) AS recency_days
  FROM base
), qs AS (
  SELECT quantile_cont(recency_days, [0.25, 0.5, 0.75]) AS qr,
         quantile_cont(frequency, [0.25, 0.5, 0.75]) AS qf,
         quantile_cont(monetary, [0.25, 0.5, 0.75]) AS qm
  FROM rb
), sc AS (
  SELECT rb.*,
         CAST(5 - {_qscore('recency_days', 'qr')} AS INTEGER) AS r_score,
         CAST({_qscore('frequency', 'qf')} AS INTEGER) AS f_score,
         CAST({_qscore('monetary', 'qm')} AS INTEGER) AS m_score
  FROM rb, qs
), rfm AS (
  SELECT customer_id, recency_days, frequency, monetary, first_purchase, last_purchase,
         r_score, f_score, m_score, r_score + f_score + m_score AS rfm_score,
         CASE WHEN r_score + f_score + m_score >= 10 THEN 'Platinum'
              WHEN r_score + f_score + m_score >= 8 THEN 'Gold'
              WHEN r_score + f_score + m_score >= 6 THEN 'Silver'
              ELSE 'Bronze' END AS tier
  FROM sc
)"""

TIER_SUMMARY = """tsum AS (
  SELECT tier, customers, round(CAST(revenue_x AS DOUBLE), 2) AS revenue,
         round(CAST(revenue_x AS DOUBLE) / customers, 6) AS avg_monetary,
         CAST(frequency_x AS DOUBLE) / customers AS avg_frequency,
         CAST(recency_x AS DOUBLE) / customers AS avg_recency_days,
         round(CAST(revenue_x AS DOUBLE) / NULLIF(CAST(sum(revenue_x) OVER () AS DOUBLE), 0), 6)
           AS revenue_share,
         CAST(customers AS DOUBLE) / NULLIF(CAST(sum(customers) OVER () AS DOUBLE), 0)
           AS customer_share
  FROM (SELECT tier, count(*) AS customers,
               sum(CAST(monetary AS DECIMAL(38,4))) AS revenue_x,
               sum(frequency) AS frequency_x, sum(recency_days) AS recency_x
        FROM rfm GROUP BY tier)
)"""


def at_risk_cte(days: int = 90, pct: float = 0.75) -> str:
    return f"""thr AS (
  SELECT monetary AS t FROM (
    SELECT monetary, row_number() OVER (ORDER BY monetary) - 1 AS rn, count(*) OVER () AS n
    FROM rfm WHERE monetary IS NOT NULL)
  WHERE rn = CAST(floor((n - 1) * {pct} + 0.5) AS BIGINT)
), at_risk AS (
  SELECT rfm.* FROM rfm, thr WHERE recency_days >= {days} AND monetary >= t
)"""


COHORT = """am AS (
  SELECT DISTINCT customer_id, month_start FROM tx WHERE customer_id IS NOT NULL
), fc AS (
  SELECT customer_id, min(month_start) AS cohort_month FROM am GROUP BY customer_id
), cm AS (
  SELECT a.cohort_month, a.period_month, a.active_customers,
         CAST((year(a.period_month) - year(a.cohort_month)) * 12
              + month(a.period_month) - month(a.cohort_month) AS INTEGER) AS months_since,
         s.cohort_size,
         CAST(a.active_customers AS DOUBLE) / CAST(s.cohort_size AS DOUBLE) AS retention
  FROM (SELECT cohort_month, month_start AS period_month, count(*) AS active_customers
        FROM am JOIN fc USING (customer_id) GROUP BY 1, 2) a
  JOIN (SELECT cohort_month, count(*) AS cohort_size FROM fc GROUP BY 1) s USING (cohort_month)
)"""


def cohort_pivot_sql(max_periods: int = 12) -> str:
    cols = ",\n       ".join(
        f'first(retention) FILTER (WHERE months_since = {i}) AS "{i}"'
        for i in range(max_periods + 1)
    )
    return (f"SELECT cohort_month,\n       {cols}\nFROM cm WHERE months_since <= {max_periods}"
            " GROUP BY cohort_month ORDER BY cohort_month")


DAILY = """d AS (
  SELECT product_id, purchase_date AS ds, CAST(sum(quantity) AS BIGINT) AS y
  FROM tx GROUP BY 1, 2
), dense AS (
  SELECT s.product_id, s.ds, CAST(coalesce(d.y, 0) AS BIGINT) AS y
  FROM (SELECT product_id, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds
        FROM d GROUP BY product_id) s
  LEFT JOIN d USING (product_id, ds)
)"""

TOP_SKUS = """top AS (
  SELECT product_id FROM tx GROUP BY product_id
  ORDER BY coalesce(sum(net_revenue), 0) DESC, product_id LIMIT 50
)"""
