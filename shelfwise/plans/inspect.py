"""Plan-shape checks used by tests and when reviewing a query's plan."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def physical_plan(df: DataFrame) -> str:
    """The executed-plan text (formatted mode) without running the query."""
    return df._jdf.queryExecution().executedPlan().toString()


def formatted_plan(df: DataFrame) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def single_partition_exchanges(df: DataFrame) -> int:
    return len(re.findall(r"Arguments: SinglePartition", formatted_plan(df)))


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[(.*?)\]", formatted_plan(df))


def read_schemas(df: DataFrame) -> list[str]:
    return re.findall(r"ReadSchema: (struct<.*?>)", formatted_plan(df))


def has_operator(df: DataFrame, name: str) -> bool:
    return name in formatted_plan(df)
