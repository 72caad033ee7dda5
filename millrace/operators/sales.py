"""Pivots, rankings, growth and rolling means over revenue rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.scan import PART, blocks, ordered, running

from millrace.plans.checkpoints import cut


def monthly_pivot(df: DataFrame, index: Sequence[str], column, values: Sequence, measure: str, digits: int | None = 2) -> DataFrame:
    """Sum of ``measure`` by ``index``, one output column for each of ``values``; absent cells are 0.

    The list of values is given, so no job looks for them. ``digits=None`` leaves sums unrounded.
    """
    wide = df.withColumn("_column", column).groupBy(*index).pivot("_column", list(values)).agg(F.sum(measure))
    cell = lambda v: F.coalesce(F.col(f"`{v}`"), F.lit(0))
    return wide.select(*index, *((cell(v) if digits is None else F.bround(cell(v), digits)).alias(str(v)) for v in values))


def top_n_per_group(df: DataFrame, group: Sequence[str], item: Sequence[str], measure: str, n: int = 3) -> DataFrame:
    """Items of each group whose dense rank by summed ``measure`` is at most n; ties may give more than n rows."""
    total = df.groupBy(*group, *item).agg(F.sum(measure).alias(measure))
    rank = F.dense_rank().over(Window.partitionBy(*group).orderBy(F.desc(measure)))
    return total.withColumn("rank", rank).where(F.col("rank") <= n)


def yoy_growth(df: DataFrame, key: Sequence[str], year: str, measure: str, first: int, second: int, digits: int | None = 2) -> DataFrame:
    """Percentage growth of summed ``measure`` from one year to the next, best first; null where the first year has none."""
    of = lambda y: F.coalesce(F.sum(F.when(F.col(year) == y, F.col(measure))), F.lit(0))
    both = df.where(F.col(year).isin(first, second)).groupBy(*key).agg(of(first).alias(f"y{first}"), of(second).alias(f"y{second}"))
    growth = F.try_divide((F.col(f"y{second}") - F.col(f"y{first}")).cast("double"), F.col(f"y{first}").cast("double")) * 100
    return both.withColumn("yoy_pct", growth if digits is None else F.bround(growth, digits)).orderBy(F.desc_nulls_last("yoy_pct"), *key)


def rolling_trend(df: DataFrame, group: Sequence[str], period: str, measure: str, window: int = 3) -> DataFrame:
    """Sum by group and period, and its mean over the last ``window`` rows (periods without rows are skipped)."""
    total = df.groupBy(*group, period).agg(F.sum(measure).alias(measure))
    if not group:
        rows = blocks(running(ordered(total, [period]), [period], _at=("sum", F.lit(1))), "_at", window - 1)
        over = Window.partitionBy("_block").orderBy("_at").rowsBetween(-(window - 1), 0)
        return rows.withColumn(f"rev_rolling_{window}m", F.avg(measure).over(over)).where("_own").drop(PART, "_at", "_block", "_own")
    over = Window.partitionBy(*group).orderBy(period).rowsBetween(-(window - 1), 0)
    return total.withColumn(f"rev_rolling_{window}m", F.avg(measure).over(over))


def top_k_frequent(df: DataFrame, value: str, k: int) -> DataFrame:
    """The k most frequent values; at the boundary the larger value stays."""
    return df.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc(value)).limit(k)


def cohort_counts(tx: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """(cohort, period, n_users): users by the month of their first row and the months since then."""
    month = F.date_trunc("month", ts)
    first = F.date_trunc("month", F.min(ts).over(Window.partitionBy(user)))
    rows = tx.select(F.col(user).alias("_user"), month.alias("_month"), first.alias("cohort"))
    period = (F.year("_month") - F.year("cohort")) * 12 + F.month("_month") - F.month("cohort")
    return rows.withColumn("period", period).groupBy("cohort", "period").agg(F.count_distinct("_user").alias("n_users"))


def cohort_retention(tx: DataFrame, user: str = "user_id", ts: str = "ts", max_periods: int | None = None) -> DataFrame:
    """One row a cohort: cohort_size and, for each month since, the share still active in percent (the ratio is rounded to
    three places first). Months that a cohort cannot have reached are 0, as absent ones are. All months of the data are
    columns, which one job counts, unless ``max_periods`` says how many."""
    counts = cohort_counts(tx, user, ts)
    if max_periods is None:
        counts = cut(counts)
        max_periods = (counts.agg(F.max("period")).first()[0] or 0) + 1
    wide = counts.groupBy("cohort").pivot("period", list(range(max_periods))).agg(F.sum("n_users"))
    size = F.col("`0`")
    cells = [(F.bround(F.try_divide(F.coalesce(F.col(f"`{p}`"), F.lit(0)), size), 3) * 100).alias(f"m{p}") for p in range(max_periods)]
    return wide.select("cohort", size.alias("cohort_size"), *cells)


def long_matrix(matrix: DataFrame) -> DataFrame:
    """(cohort, cohort_size, period, retention): a retention matrix with a row for each cell."""
    names = [c for c in matrix.columns if c[0] == "m" and c[1:].isdigit()]
    cells = F.array(*(F.struct(F.lit(int(c[1:])).alias("period"), F.col(c).alias("retention")) for c in names))
    return matrix.select("cohort", "cohort_size", F.explode(cells).alias("x")).select("cohort", "cohort_size", "x.*")


def mean_curve(matrix: DataFrame, known_only: bool = False) -> DataFrame:
    """(period, retention): column means of a retention matrix; with ``known_only`` cells of 0 do not count."""
    names = [c for c in matrix.columns if c[0] == "m" and c[1:].isdigit()]
    long = matrix.select(F.explode(F.array(*(F.struct(F.lit(int(c[1:])).alias("period"), F.col(c).alias("value")) for c in names))).alias("x")).select("x.*")
    return long.where("value > 0" if known_only else "true").groupBy("period").agg(F.avg("value").alias("retention"))


def render_retention(matrix: DataFrame, max_periods: int = 8) -> str:
    """A retention matrix as text, one line a cohort; a matrix is a report of few rows."""
    names = [c for c in matrix.columns if c[0] == "m" and c[1:].isdigit()][:max_periods]
    lines = ["cohort    size " + " ".join(f"{c:>6}" for c in names)]
    for r in matrix.orderBy("cohort").select(F.date_format("cohort", "yyyy-MM").alias("cohort"), "cohort_size", *names).toLocalIterator():
        lines.append(f"{r.cohort:<8} {r.cohort_size:>6} " + " ".join(f"{r[c]:>6.1f}" for c in names))
    return "\n".join(lines)
