"""Exact quantiles by selection: nested histograms of the bits of doubles, no group's values in one state.

A double's 64 bits, with all but the sign turned over for negative values, sort like the double. A first pass counts values by
group and leading 16 bits; running sums of these at most 65,536 counts find the bucket of a wanted rank; the next pass counts
only values of that bucket by their next 16 bits, and so on: four levels give the value. The wanted buckets are a few rows a
group. A level shuffles pre-aggregated counts, never values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.checkpoints import cut, release, small

LEVELS, BITS = 4, 16


def sortable(x: Column) -> Column:
    """A double as a whole number of the same order; both zeros are one. No NaN."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x + F.lit(0.0)).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(0x7FFFFFFFFFFFFFFF))).otherwise(bits)


def double_of(key: Column) -> Column:
    bits = F.when(key < 0, key.bitwiseXOR(F.lit(0x7FFFFFFFFFFFFFFF))).otherwise(key)
    return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def group_quantiles(df: DataFrame, value: str, shares: Sequence[float], names: Sequence[str], group: str | None = None) -> DataFrame:
    """(group, *names): for each group the quantiles at ``shares`` (0 to 1), interpolated between neighbouring values.

    Nulls and NaN are left out; groups without values have no row, and the null group is one of its own. Without ``group``
    there is one row, or none. With a group column named like a name, an error.
    """
    if group in names:
        raise ValueError(f"{group} is the group")
    x = F.nanvl(F.col(value).cast("double"), F.lit(None))
    keys = cut(df.select((F.col(group) if group else F.lit(0)).alias("g"), x.alias("x")).where("x is not null").select("g", sortable(F.col("x")).alias("key")))
    counts = keys.groupBy("g").agg(F.count("*").alias("n"))
    at = [F.lit(float(s)) * (F.col("n") - 1) for s in shares]
    # ranks from 0 that are wanted of a group: the neighbours of each quantile's place
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(a), F.ceil(a)) for a in at))))
    groups = cut(counts)
    wanted = groups.select("g", F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("prefix")).withColumn("left", F.col("rank"))
    for level in range(LEVELS):
        shift = 64 - BITS * (level + 1)
        upto = F.shiftright("key", shift)  # the bits down to this level; the prefix is what precedes its last 16
        buckets = wanted.select("g", "prefix").distinct()
        inside = keys.select("g", upto.alias("upto"), F.lit(0).cast("long").alias("prefix") if level == 0 else F.shiftright("key", shift + BITS).alias("prefix"))
        on = [inside["g"].eqNullSafe(buckets["g"]), inside["prefix"] == buckets["prefix"]]
        seen = inside if level == 0 else inside.join(small(buckets), on, "left_semi")
        histogram = seen.groupBy("g", "prefix", "upto").agg(F.count("*").alias("n"))
        running = histogram.withColumn("to", F.sum("n").over(Window.partitionBy("g", "prefix").orderBy("upto"))).withColumn("from", F.col("to") - F.col("n"))
        ask = wanted.select(F.col("g").alias("wg"), F.col("prefix").alias("wp"), "rank", "left")
        found = running.join(ask, F.col("g").eqNullSafe(F.col("wg")) & (F.col("prefix") == F.col("wp")) & (F.col("left") >= F.col("from")) & (F.col("left") < F.col("to")))
        before, wanted = wanted, cut(found.select("g", "rank", F.col("upto").alias("prefix"), (F.col("left") - F.col("from")).alias("left")))
        if level:
            release(before)
    release(keys)
    values = wanted.select(F.col("g").alias("vg"), "rank", double_of(F.col("prefix")).alias("x")).groupBy("vg").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("v"))
    rows = groups.join(values, F.col("g").eqNullSafe(F.col("vg")))
    low, high = ([F.element_at("v", f(a)) for a in at] for f in (F.floor, F.ceil))
    between = [F.when(a == F.floor(a), x).otherwise(x * (1.0 - (a - F.floor(a))) + y * (a - F.floor(a))) for a, x, y in zip(at, low, high, strict=True)]
    return rows.select(*([F.col("g").alias(group)] if group else []), *(b.alias(n) for b, n in zip(between, names, strict=True)))
