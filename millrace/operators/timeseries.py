"""Regular grids, gap filling, runs of gaps and rolling anomalies.

Every operator works within ``by`` (a list of key columns). With an empty list the order is global: rows are dealt by ranges of
time, and what a row needs from others comes as one summary a partition, or as copies of the few rows before a block
(``plans.scan``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.scan import PART, blocks, ordered, running


def regularize(df: DataFrame, by: Sequence[str] = (), ts: str = "ts", value: str = "value", step: str = "1 hour") -> DataFrame:
    """Every step from the first to the last timestamp of each series, with ``value`` (null where missing) and is_missing.

    Timestamps that repeat are averaged, so the grid has one row a step. NaN counts as missing.
    """
    clean = df.select(*by, ts, F.nanvl(F.col(value).cast("double"), F.lit(None)).alias(value)).groupBy(*by, ts).agg(F.avg(value).alias(value))
    ends = clean.groupBy(*by).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    grid = ends.where("_a is not null").select(*by, F.explode(F.sequence("_a", "_b", F.expr(f"interval {step}"))).alias(ts))
    out = grid.join(clean, [*by, ts], "left")
    return out.withColumn("is_missing", F.col(value).isNull())


def fill_strategies(reg: DataFrame, by: Sequence[str] = (), ts: str = "ts", value: str = "value") -> DataFrame:
    """With ffill, linear (by row position; the last value goes on, leading gaps stay), seasonal (mean of the hour of day)
    and composite (linear, else seasonal, else the nearest value after, else before)."""
    if not by:
        numbered = running(ordered(reg, [ts]), [ts], _at=("sum", F.lit(1)))
        known = F.when(F.col(value).isNotNull(), F.struct(F.col("_at").alias("at"), F.col(value).alias("v")))
        hours = reg.groupBy(F.hour(ts).alias("_hour")).agg(F.avg(value).alias("_mean"))  # 24 rows
        rows = running(numbered, [ts], _p=("last", known), _n=("next", known)).join(F.broadcast(hours), F.hour(ts).eqNullSafe(F.col("_hour")))
        return _filled(rows, value, F.col("_mean")).drop("_hour", "_mean", PART)
    order = Window.partitionBy(*by).orderBy(ts)
    back = order.rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(F.desc(ts)).rowsBetween(Window.unboundedPreceding, 0)
    at = F.row_number().over(order)
    reg = reg.withColumn("_at", at)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_at").alias("at"), F.col(value).alias("v")))
    reg = reg.withColumn("_p", F.last(known, True).over(back)).withColumn("_n", F.last(known, True).over(ahead))
    return _filled(reg, value, F.avg(value).over(Window.partitionBy(*by, F.hour(ts))))


def _filled(rows: DataFrame, value: str, mean: Column) -> DataFrame:
    """From _at (row number), _p and _n (at, v: the nearest known values before and after)."""
    share = F.try_divide((F.col("_at") - F.col("_p.at")).cast("double"), F.col("_n.at") - F.col("_p.at"))
    linear = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_n").isNull(), F.col("_p.v")).otherwise(F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * share)
    out = rows.withColumn("ffill", F.col("_p.v")).withColumn("linear", linear).withColumn("seasonal", F.coalesce(F.col(value), mean))
    return out.withColumn("composite", F.coalesce("linear", "seasonal", F.col("_n.v"), F.col("_p.v"))).drop("_at", "_p", "_n")


def long_gaps(reg: DataFrame, by: Sequence[str] = (), ts: str = "ts", min_run: int = 3) -> DataFrame:
    """(start, end, length) of runs of at least ``min_run`` missing rows."""
    if not by:
        rows = running(ordered(reg, [ts]), [ts], _at=("sum", F.lit(1)), _missing=("sum", F.col("is_missing").cast("int")))
        runs = rows.where("is_missing").groupBy((F.col("_at") - F.col("_missing")).alias("_run"))
        return runs.agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("length")).where(F.col("length") >= min_run).drop("_run")
    order = Window.partitionBy(*by).orderBy(ts)
    run = F.row_number().over(order) - F.row_number().over(Window.partitionBy(*by, "is_missing").orderBy(ts))
    runs = reg.withColumn("_run", run).where("is_missing").groupBy(*by, "_run")
    return runs.agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("length")).where(F.col("length") >= min_run).drop("_run")


def rolling_anomalies(filled: DataFrame, by: Sequence[str] = (), ts: str = "ts", value_col: str = "composite", window: int = 12, z_threshold: float = 2.5, digits: int | None = 3) -> DataFrame:
    """With roll_mean, roll_std (sample, over the last ``window`` rows if at least half have values), z and anomaly."""
    if by:
        rows, over = filled, Window.partitionBy(*by).orderBy(ts).rowsBetween(-(window - 1), 0)
    else:
        rows = blocks(running(ordered(filled, [ts]), [ts], _at=("sum", F.lit(1))), "_at", window - 1)
        over = Window.partitionBy("_block").orderBy("_at").rowsBetween(-(window - 1), 0)
    enough = F.count(value_col).over(over) >= window // 2
    cut = (lambda c: c) if digits is None else (lambda c: F.bround(c, digits))
    out = rows.withColumn("roll_mean", cut(F.when(enough, F.avg(value_col).over(over)))).withColumn("roll_std", cut(F.when(enough, F.stddev_samp(value_col).over(over))))
    out = out.withColumn("z", cut(F.try_divide(F.col(value_col) - F.col("roll_mean"), F.nullif(F.col("roll_std"), F.lit(0.0)))))
    out = out.withColumn("anomaly", F.coalesce(F.abs("z") > z_threshold, F.lit(False)))
    return out if by else out.where("_own").drop(PART, "_at", "_block", "_own")
