"""Seeded demonstration tables, generated by Spark; values depend on the seed and the number of partitions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _pick(values: list[str], seed: int):
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(F.rand(seed) * len(values)) + 1).cast("int"))


def make_sales(spark: SparkSession, n_rows: int = 5000, seed: int = 42) -> DataFrame:
    rows = spark.range(n_rows, numPartitions=1)
    day = F.floor(F.rand(seed) * 731).cast("int")
    rows = rows.select(
        F.date_add(F.to_date(F.lit("2024-01-01")), day).cast("timestamp_ntz").alias("date"), _pick(["North", "South", "East", "West"], seed + 1).alias("region"),
        _pick(["alpha", "beta", "gamma", "delta", "epsilon", "zeta"], seed + 2).alias("product"), (F.floor(F.rand(seed + 3) * 9) + 1).cast("long").alias("qty"), (F.rand(seed + 4) * 115 + 5).alias("unit_price"))
    return rows.withColumn("revenue", F.bround(F.col("qty") * F.col("unit_price"), 2)).withColumn("year", F.year("date")).withColumn("month", F.trunc("date", "month")).orderBy("date")


def make_transactions(spark: SparkSession, n_users: int = 1500, months: int = 12, seed: int = 7) -> DataFrame:
    users = spark.range(n_users, numPartitions=1).select(F.col("id").alias("user_id"), F.floor(F.rand(seed) * months).cast("int").alias("first"))
    active = users.select("user_id", "first", F.explode(F.sequence(F.col("first"), F.lit(months - 1))).alias("m"))
    active = active.withColumn("u", F.rand(seed + 1)).where((F.col("m") == F.col("first")) | (F.col("u") < F.exp(-(F.col("m") - F.col("first")) / 5.0)))
    often = active.select("user_id", "m", F.explode(F.sequence(F.lit(1), (F.floor(F.rand(seed + 2) * 3) + 1).cast("int"))).alias("k"))
    day = F.floor(F.rand(seed + 3) * 27).cast("int")
    return often.select("user_id", F.date_add(F.add_months(F.lit("2025-01-01").cast("date"), F.col("m")), day).cast("timestamp_ntz").alias("ts"))


def make_sensor_stream(spark: SparkSession, days: int = 14, gap_rate: float = 0.18, seed: int = 11) -> DataFrame:
    hours = spark.range(days * 24, numPartitions=1).select(F.col("id").alias("h"), F.rand(seed).alias("u"), F.randn(seed + 1).alias("e"))
    value = 20 + 5 * F.sin(F.col("h") * 2 * F.pi() / 24) + F.col("e") * 0.5 + F.when(F.col("h") % (days * 24 // 5) == 17, 15).otherwise(0)
    ts = F.lit("2025-03-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("h").cast("int"))
    return hours.where(F.col("u") >= gap_rate).select(ts.alias("ts"), value.alias("value"))


def make_outliers(spark: SparkSession, n: int = 2000, seed: int = 3) -> DataFrame:
    rows = spark.range(n, numPartitions=1).select(F.rand(seed).alias("r"), F.randn(seed + 1).alias("e"), F.rand(seed + 2).alias("u"), F.rand(seed + 3).alias("s"))
    region = F.when(F.col("r") < 0.5, "A").when(F.col("r") < 0.8, "B").otherwise("C")
    side = F.when(F.col("s") < 0.5, -1).otherwise(1)
    shift = F.when(F.col("u") < 0.03, side * 60).when(F.col("u") < 0.05, side * 18).otherwise(0)
    return rows.select(region.alias("region"), (100 + 5 * F.col("e") + shift).alias("value"), (F.col("u") < 0.03).alias("is_planted_extreme"))
