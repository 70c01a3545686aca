"""Monthly acquisition cohorts.

Plan: one shuffle on customer_id gathers each customer's set of active
months (``collect_set`` aggregates partially on the map side, and a set is
bounded by the number of calendar months, however many rows a customer has);
the cohort month is the set's minimum; exploding the set and counting per
(cohort, period) is a second, small shuffle. No self-join of the fact table.
Rows with a null customer_id are left out of both activity and cohort sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.calendar import months_between_starts

MATRIX_COLUMNS = [
    "cohort_month", "period_month", "active_customers", "months_since", "cohort_size",
    "retention",
]


def _active_months(df: DataFrame) -> DataFrame:
    return (
        df.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(F.collect_set("month_start").alias("months"))
    )


def first_purchase_month(df: DataFrame) -> DataFrame:
    """customer_id, cohort_month = first month with a purchase."""
    return (
        df.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(F.min("month_start").alias("cohort_month"))
    )


def monthly_cohort_matrix(df: DataFrame) -> DataFrame:
    """cohort_month, period_month, active_customers, months_since,
    cohort_size, retention. Only periods with activity appear (a gap gives no
    row). cohort_size is the month-0 activity, attached with a window over the
    aggregated matrix (cohorts × periods rows, bounded by the calendar)."""
    act = (
        _active_months(df)
        .select(
            F.array_min("months").alias("cohort_month"),
            F.explode("months").alias("period_month"),
        )
        .groupBy("cohort_month", "period_month")
        .agg(F.count(F.lit(1)).alias("active_customers"))
    )
    size = F.sum(
        F.when(F.col("period_month") == F.col("cohort_month"), F.col("active_customers"))
    ).over(Window.partitionBy("cohort_month"))
    return (
        act.withColumn("months_since", months_between_starts("period_month", "cohort_month"))
        .withColumn("cohort_size", size)
        .withColumn(
            "retention",
            F.col("active_customers").cast("double") / F.col("cohort_size").cast("double"),
        )
        .select(*MATRIX_COLUMNS)
        .orderBy("cohort_month", "months_since")
    )


def cohort_heatmap_pivot(matrix: DataFrame, max_periods: int = 12) -> DataFrame:
    """One row per cohort, one retention column per months_since 0..max
    (named "0", "1", …). The column list is fixed, so the pivot needs no extra
    job to discover values and the schema does not depend on the data."""
    return (
        matrix.filter(F.col("months_since") <= max_periods)
        .groupBy("cohort_month")
        .pivot("months_since", list(range(0, max_periods + 1)))
        .agg(F.first("retention"))
        .orderBy("cohort_month")
    )


def average_retention_curve(matrix: DataFrame, max_periods: int = 12) -> DataFrame:
    """months_since, avg_retention — the unweighted mean over cohorts."""
    return (
        matrix.filter(F.col("months_since") <= max_periods)
        .groupBy("months_since")
        .agg(F.avg("retention").alias("avg_retention"))
        .orderBy("months_since")
    )
