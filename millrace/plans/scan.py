"""Running values in a global order without one partition for all rows.

Rows are dealt by ranges of the order and written once; every partition is summed up to one row; the driver folds these rows,
one a partition, to what each partition starts from (or ends at); windows within partitions add their own part. Nothing but
one row a partition reaches the driver or is broadcast, and no plan has an exchange to a single partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.checkpoints import cut

PART = "_part"


def ordered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` with its partition in a division by ranges of ``order``, written to the shared folder. Rows with equal values in
    ``order`` share a partition, so the order should be (nearly) complete; nulls come first."""
    return cut(df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()))


def running(df: DataFrame, order: Sequence[str], **values: tuple[str, Column]) -> DataFrame:
    """``df``, from :func:`ordered`, with a column for each of ``values``, a kind and an expression:

    ``sum`` and ``max``: over all rows up to and with this one; ``before``: the maximum over all rows before this one;
    ``last``: the last that is not null, up to and with this one; ``next``: the first that is not null, from this one on.
    Sums of nothing are 0, the others null.
    """
    place = F.struct(*order)
    whole = {"sum": lambda c: F.coalesce(F.sum(c), F.lit(0)), "max": F.max, "before": F.max, "last": lambda c: F.max_by(c, F.when(c.isNotNull(), place)), "next": lambda c: F.min_by(c, F.when(c.isNotNull(), place))}
    totals = df.groupBy(PART).agg(*(whole[kind](c).alias(name) for name, (kind, c) in values.items()))
    fields = totals.schema
    totals = sorted(totals.collect(), key=lambda r: r[PART])  # one row a partition
    carried = {r[PART]: [r[PART]] for r in totals}
    for name, (kind, _) in values.items():
        now = 0 if kind == "sum" else None
        for r in reversed(totals) if kind == "next" else totals:
            carried[r[PART]].append(now)
            if r[name] is not None:
                now = now + r[name] if kind == "sum" else r[name] if kind in ("last", "next") or now is None else max(now, r[name])
    names = {name: f"_carried_{name}" for name in values}
    carry = df.sparkSession.createDataFrame(list(carried.values()), fields).select(PART, *(F.col(n).alias(c) for n, c in names.items()))
    window = Window.partitionBy(PART).orderBy(*order)
    upto, before = window.rowsBetween(Window.unboundedPreceding, 0), window.rowsBetween(Window.unboundedPreceding, -1)
    # what follows is what precedes in falling order: a frame that grows is filled once, one that shrinks again for every row
    after = Window.partitionBy(PART).orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    local = {
        "sum": lambda c, old: F.coalesce(F.sum(c).over(upto), F.lit(0)) + old, "max": lambda c, old: F.greatest(F.max(c).over(upto), old), "before": lambda c, old: F.greatest(F.max(c).over(before), old),
        "last": lambda c, old: F.coalesce(F.last(c, True).over(upto), old), "next": lambda c, old: F.coalesce(F.last(c, True).over(after), old),
    }
    out = df.join(F.broadcast(carry), PART)
    return out.select(*df.columns, *(local[kind](c, F.col(names[name])).alias(name) for name, (kind, c) in values.items()))


def blocks(df: DataFrame, number: str, reach: int, size: int = 1 << 16) -> DataFrame:
    """``df``, numbered without gaps from 1 by ``number``, with ``_block`` and ``_own``: blocks of at least ``size`` rows, each
    begun by copies (``_own`` false) of the ``reach`` rows before it. A window over up to ``reach`` preceding rows within a
    block then equals the global one on the block's own rows."""
    size = max(size, reach)
    at = F.floor((F.col(number) - 1) / size)
    ahead = F.floor((F.col(number) - 1 + reach) / size)
    places = F.when(ahead > at, F.array(F.struct(at.alias("b"), F.lit(True).alias("o")), F.struct(ahead.alias("b"), F.lit(False).alias("o")))).otherwise(F.array(F.struct(at.alias("b"), F.lit(True).alias("o"))))
    return df.withColumn("_place", F.explode(places)).select(*df.columns, F.col("_place.b").alias("_block"), F.col("_place.o").alias("_own"))
