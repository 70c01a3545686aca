"""RFM segmentation.

The per-customer base (one row per customer) is the only frame read more than
once — for the reference date, the quartile cut points and the scores — so
it is persisted. Cut points come from the exact distributed selection in
``functions.stats``; they are a handful of numbers, and the scored frame is a
projection of the base with those numbers as literals.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.measures import as_double, money_sum, order_key, safe_div
from shelfwise.functions.stats import both_quantiles, column_stats, quantiles, quartile_score
from shelfwise.session import hold

QUARTILES = [0.25, 0.5, 0.75]
EPOCH = date(1970, 1, 1)

# Tier names with the minimum composite score of each, best
# first; anything below the last threshold is Bronze.
TIER_THRESHOLDS = [("Platinum", 10), ("Gold", 8), ("Silver", 6)]
TIERS = ["Platinum", "Gold", "Silver", "Bronze"]

RFM_COLUMNS = [
    "customer_id", "recency_days", "frequency", "monetary", "first_purchase",
    "last_purchase", "r_score", "f_score", "m_score", "rfm_score", "tier",
]


def reference_date(df: DataFrame) -> DataFrame:
    """One-row frame with the latest purchase date. (The reference's
    docstring speaks of "+ 1 day"; its code does not add it, nor do we, so the
    most recent customer has recency 0.)"""
    return df.agg(F.max("purchase_date").alias("reference_date"))


def customer_base(df: DataFrame) -> DataFrame:
    """Per customer: frequency (distinct invoices), monetary (null where a line's
    money is not a finite number), first and last purchase. One shuffle on
    customer_id, partial aggregation map-side."""
    base = df.groupBy("customer_id").agg(
        F.count_distinct(order_key(df)).alias("frequency"),
        as_double(money_sum("net_revenue")).alias("monetary"),
        F.min("purchase_date").alias("first_purchase"),
        F.max("purchase_date").alias("last_purchase"),
    )
    finite = F.abs("monetary") < F.lit(float("inf"))  # false for NaN: it sorts above
    return base.withColumn("monetary", F.when(finite, F.col("monetary")))


def tier_of(score: str = "rfm_score"):
    expr = None
    for name, threshold in TIER_THRESHOLDS:
        cond = F.col(score) >= threshold
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(TIERS[-1]))


def compute_rfm(
    df: DataFrame,
    ref_date: date | None = None,
    approx_accuracy: int | None = None,
) -> DataFrame:
    """recency_days, frequency, monetary, first/last purchase, quartile
    scores (r = 5 − quartile of recency), rfm_score 3..12 and tier.

    Quartile cut points interpolate linearly between order statistics; bins
    are right-closed. Recency is ref − last purchase, so its cut points are
    those of −day(last purchase) shifted by the reference day; one statistics
    job yields the reference day (the latest purchase) together with the
    counts and ranges the selection starts from. Those jobs run when called,
    also for an ``explain``; the returned frame is lazy over the persisted
    base, which ``session.release()`` lets go.
    """
    base = hold(customer_base(df).withColumn("_neg_lp", -F.unix_date("last_purchase")))
    cols = ["_neg_lp", "frequency", "monetary"]
    stats = None if approx_accuracy else column_stats(base, cols)
    if ref_date is None:
        if stats is None:
            ref_date = base.agg(F.max("last_purchase")).first()[0]
        elif stats["_neg_lp"][1] is not None:
            ref_date = EPOCH + timedelta(days=int(-stats["_neg_lp"][1]))
    probs = {c: QUARTILES for c in cols}
    if approx_accuracy:
        q, nearest = quantiles(base, probs, approx_accuracy=approx_accuracy), None
    else:
        q, nearest = both_quantiles(base, probs, stats)
    if ref_date is None:  # empty input
        rec, rec_q = F.lit(None).cast("int"), [None] * 3
    else:
        ref_days = (ref_date - EPOCH).days
        rec = F.datediff(F.lit(ref_date), F.col("last_purchase"))
        rec_q = [None if v is None else ref_days + v for v in q["_neg_lp"]]
    scored = base.withColumn("recency_days", rec).withColumns(
        {
            "r_score": (F.lit(5) - quartile_score("recency_days", rec_q)).cast("int"),
            "f_score": quartile_score("frequency", q["frequency"]),
            "m_score": quartile_score("monetary", q["monetary"]),
        }
    )
    scored = scored.withColumn(
        "rfm_score", (F.col("r_score") + F.col("f_score") + F.col("m_score")).cast("int")
    ).withColumn("tier", tier_of())
    out = scored.select(*RFM_COLUMNS)
    if nearest is not None:  # ``at_risk_customers`` need not select them again
        out.monetary_ranks = dict(zip(QUARTILES, nearest["monetary"], strict=True))
    return out


def tier_summary(rfm: DataFrame) -> DataFrame:
    """R2: tier, customers, revenue, avg_monetary, avg_frequency,
    avg_recency_days, revenue_share, customer_share — revenue descending.
    The shares' totals are windows over the four-row result."""
    g = rfm.groupBy("tier").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("monetary").alias("revenue_x"),
        F.sum("frequency").alias("frequency_x"),
        F.sum("recency_days").alias("recency_x"),
    )
    w = Window.partitionBy()
    return g.select(
        "tier",
        "customers",
        as_double("revenue_x").alias("revenue"),
        (as_double("revenue_x") / F.col("customers")).alias("avg_monetary"),
        (as_double("frequency_x") / F.col("customers")).alias("avg_frequency"),
        (as_double("recency_x") / F.col("customers")).alias("avg_recency_days"),
        safe_div(as_double("revenue_x"), as_double(F.sum("revenue_x").over(w))).alias(
            "revenue_share"
        ),
        safe_div(
            F.col("customers").cast("double"), F.sum("customers").over(w).cast("double")
        ).alias("customer_share"),
    ).orderBy(F.desc_nulls_first("revenue"), "tier")


def at_risk_customers(
    rfm: DataFrame,
    recency_threshold_days: int = 90,
    min_monetary_percentile: float = 0.75,
    approx_accuracy: int | None = None,
) -> DataFrame:
    """Customers quiet for at least the threshold whose monetary value is
    at or above the given percentile of *all* customers ('nearest' rank);
    monetary descending."""
    known = getattr(rfm, "monetary_ranks", {}) if not approx_accuracy else {}
    if min_monetary_percentile in known:
        thr = known[min_monetary_percentile]
    else:
        thr = quantiles(
            rfm, {"monetary": [min_monetary_percentile]}, "nearest", approx_accuracy
        )["monetary"][0]
    if thr is None:
        return rfm.limit(0)
    return rfm.filter(
        (F.col("recency_days") >= recency_threshold_days) & (F.col("monetary") >= F.lit(thr))
    ).orderBy(F.desc_nulls_first("monetary"), "customer_id")


def at_risk_revenue(at_risk: DataFrame) -> DataFrame:
    """One row — customers, dollars_at_risk (0 when empty),
    avg_customer_value (null when empty)."""
    return at_risk.agg(
        F.count(F.lit(1)).alias("customers"),
        money_sum("monetary").alias("x"),
    ).select(
        "customers",
        as_double("x").alias("dollars_at_risk"),
        safe_div(as_double("x"), F.col("customers").cast("double")).alias("avg_customer_value"),
    )


# Multiplier and modulus of the sample's multiplicative hash
# (Knuth's 2^32 / golden ratio).
SAMPLE_MULT = 2654435761
SAMPLE_MOD = 4294967296


def sample_key(col: str, seed: int):
    """((id + seed) · 2654435761) mod 2^32, in exact DECIMAL arithmetic, so
    any SQL engine computes the same key."""
    x = (F.col(col).cast("decimal(38,0)") + F.lit(seed)) * F.lit(SAMPLE_MULT)
    return F.pmod(x, F.lit(SAMPLE_MOD)).cast("long")


def rfm_sample(rfm: DataFrame, n: int = 5000, seed: int = 42) -> DataFrame:
    """A4: exactly min(n, rows) customers, the same ones on every run
    whatever the partitioning: the n smallest of a seeded hash of the id
    (ties by id). Plans as a per-partition top-n, so at most n rows per
    partition move."""
    return (
        rfm.withColumn("_h", sample_key("customer_id", seed))
        .orderBy("_h", "customer_id")
        .limit(n)
        .drop("_h")
    )


def tier_lookup(summary: DataFrame) -> DataFrame:
    """A5: one row per named tier in fixed order; tiers without customers are
    kept with zero customers. The four-row tier list is a literal."""
    spark = summary.sparkSession
    names = spark.createDataFrame([(i, t) for i, t in enumerate(TIERS)], "tier_order int, tier string")
    return (
        names.join(summary, "tier", "left")
        .withColumn("customers", F.coalesce(F.col("customers"), F.lit(0)))
        .orderBy("tier_order")
    )
