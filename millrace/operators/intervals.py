"""Closed integer intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.scan import ordered, running


def merge_intervals(df: DataFrame, by: Sequence[str] = (), start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping or touching intervals of each key, merged. Without ``by`` the order is global and the running maximum is
    found by partitions (``plans.scan``). Intervals without a start or an end are left out there."""
    if not by:
        return _merge_all(df, start, end)
    order = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.select(*by, start, end).withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def _merge_all(df: DataFrame, start: str, end: str) -> DataFrame:
    longest = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).groupBy(start).agg(F.max(end).alias(end))  # a start once
    rows = running(ordered(longest, [start]), [start], _reach=("before", F.col(end)))
    rows = running(rows, [start], _run=("sum", F.when(F.col(start) <= F.col("_reach"), 0).otherwise(1)))
    return rows.groupBy("_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")
