"""Event streams: windowed sums with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_totals(events: DataFrame, ts: str = "ts", by: str = "event_type", value: str = "value", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, by, n, total) for each window; works on batch and streaming frames."""
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    rows = rows.withWatermark("_ts", late) if events.isStreaming else rows
    out = rows.groupBy(F.window("_ts", window), by).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(18,4)")).alias("total"))
    return out.select(F.col("window.start").alias("start"), by, "n", "total")
