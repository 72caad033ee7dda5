"""Outlier flags by quartiles, z-score and median deviation, and their majority vote.

Statistics are joined to the rows, one row a group; quartiles and medians are found by selection (``quantiles``), so no
group's values meet in one task. Nulls and NaN are never outliers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.quantiles import group_quantiles
from millrace.plans.checkpoints import cut, small


def detect_outliers(df: DataFrame, value_col: str = "value", group_col: str | None = None, k: float = 1.5, z: float = 3.0, mad: float = 3.5) -> DataFrame:
    """With iqr, zscore, mad (flags), score (their number) and outlier (two or more). Rows of the null group score 0."""
    rows = df.withColumn("_x", F.nanvl(F.col(value_col).cast("double"), F.lit(None))).withColumn("_g", F.col(group_col) if group_col else F.lit(0))
    known = rows.where("_g is not null").select("_g", "_x")
    moments = known.groupBy("_g").agg(F.avg("_x").alias("_mean"), F.stddev_pop("_x").alias("_std"))
    middle = cut(group_quantiles(known, "_x", (0.25, 0.5, 0.75), ("_q1", "_med", "_q3"), "_g"))
    gaps = known.join(small(middle.select("_g", "_med")), "_g").select("_g", F.abs(F.col("_x") - F.col("_med")).alias("_gap"))
    stats = cut(moments.join(middle, "_g").join(group_quantiles(gaps, "_gap", (0.5,), ("_mad",), "_g"), "_g"))
    rows = rows.join(small(stats), "_g", "left")
    width = F.col("_q3") - F.col("_q1")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return (
        rows.withColumn("iqr", flag((F.col("_x") < F.col("_q1") - k * width) | (F.col("_x") > F.col("_q3") + k * width)))
        .withColumn("zscore", flag((F.col("_std") > 0) & (F.try_divide(F.abs(F.col("_x") - F.col("_mean")), "_std") > z)))
        .withColumn("mad", flag((F.col("_mad") > 0) & (F.try_divide(0.6745 * F.abs(F.col("_x") - F.col("_med")), "_mad") > mad)))
        .withColumn("score", F.col("iqr").cast("int") + F.col("zscore").cast("int") + F.col("mad").cast("int"))
        .withColumn("outlier", F.col("score") >= 2)
        .select(*df.columns, "iqr", "zscore", "mad", "score", "outlier")
    )


def evaluate_against_truth(scored: DataFrame, truth: str, flag: str = "outlier", digits: int = 3) -> DataFrame:
    """tp, fp, fn, precision and recall; 0 where a denominator is empty."""
    is_true, said = F.col(truth), F.col(flag)
    n = scored.agg(F.count_if(is_true & said).alias("tp"), F.count_if(~is_true & said).alias("fp"), F.count_if(is_true & ~said).alias("fn"))
    ratio = lambda d: F.coalesce(F.bround(F.try_divide(F.col("tp").cast("double"), d), digits), F.lit(0.0))
    return n.withColumn("precision", ratio(F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp") + F.col("fn")))


def iqr_flags(df: DataFrame, value_col: str = "value", group_col: str | None = None, k: float = 1.5) -> DataFrame:
    """With iqr alone. There is no guard for zero spread: any other value than the quartiles' is flagged then."""
    return detect_outliers(df, value_col, group_col, k=k).select(*df.columns, "iqr")


def zscore_flags(df: DataFrame, value_col: str = "value", group_col: str | None = None, threshold: float = 3.0) -> DataFrame:
    """With zscore alone; without spread nothing is flagged."""
    return detect_outliers(df, value_col, group_col, z=threshold).select(*df.columns, "zscore")


def mad_flags(df: DataFrame, value_col: str = "value", group_col: str | None = None, threshold: float = 3.5) -> DataFrame:
    """With mad alone; without spread nothing is flagged."""
    return detect_outliers(df, value_col, group_col, mad=threshold).select(*df.columns, "mad")
