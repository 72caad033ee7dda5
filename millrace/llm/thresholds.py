"""Budgets met by thresholds on a hash: nested histograms instead of a sort.

Items of a stream have a size and a hash of ``BITS`` bits. The threshold of a budget is the hash below which the sizes add
up to the budget, as nearly as whole items allow. Each pass adds up sizes by (stream, next ``STEP`` bits), finds the bucket
in which the budget falls, and looks into that bucket alone in the next pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.checkpoints import cut

BITS, STEP = 60, 12


def hash60(column):
    """60 bits that any SQL engine can compute; null hashes as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def thresholds(items: DataFrame, budgets: DataFrame, levels: int = BITS // STEP) -> DataFrame:
    """(stream, budget, limit): items with ``hash < limit`` come nearest to the budget (a tie leaves the item out).

    With fewer ``levels`` the limit is as near as buckets of the last level allow, each of which goes or stays as a whole.

    items: (stream, hash, size), stream not null; budgets: (stream, budget double), distinct. A budget that is at least as
    large as its stream has no row.
    """
    state = None
    for level in range(levels):
        shift = BITS - STEP * (level + 1)
        bucket = F.shiftright("hash", shift).bitwiseAND((1 << STEP) - 1)
        if state is None:
            summed = items.groupBy("stream", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
            asked = budgets.select("stream", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
        else:
            ranges = state.select("stream", "prefix").distinct()
            here = items.withColumn("prefix", F.shiftright("hash", shift + STEP)).join(ranges, ["stream", "prefix"])
            summed = here.groupBy("stream", "prefix", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
            asked = state.select("stream", "budget", "prefix", "below")
        keys = ["stream"] if state is None else ["stream", "prefix"]
        running = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = summed.withColumn("upto", F.sum("n").over(running))
        hit = asked.join(summed, keys).where("below + upto > budget")
        one = hit.groupBy("stream", "budget", "prefix", "below").agg(F.min(F.struct("bucket", "upto", "n")).alias("m"))
        state = cut(one.select(
            "stream", "budget", (F.col("prefix") * (1 << STEP) + F.col("m.bucket")).alias("prefix"),
            (F.col("below") + F.col("m.upto") - F.col("m.n")).alias("below"), F.col("m.n").alias("n")))
    nearer = F.col("below") + F.col("n") - F.col("budget") < F.col("budget") - F.col("below")
    return state.select("stream", "budget", ((F.col("prefix") + F.when(nearer, 1).otherwise(0)) * (1 << (BITS - STEP * levels))).alias("limit"))
