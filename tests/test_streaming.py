from pyspark.sql import functions as F

from millrace.session import table
from millrace.streaming import events, lru

BASE = "/root/testdata/sf0.001"


def drained(frame, name, mode):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return frame.sparkSession.table(name)


def test_windowed_totals_stream_equals_batch(spark):
    batch = table(spark, BASE, "events")
    stream = spark.readStream.schema(batch.schema).parquet(f"{BASE}/events*.parquet")
    got = {tuple(r) for r in drained(events.windowed_totals(stream), "totals", "update").collect()}
    assert got == {tuple(r) for r in events.windowed_totals(batch).collect()}


def test_lru_stream_equals_batch(spark, tmp_path):
    log = spark.range(200).select((F.col("id") % 3).cast("string").alias("cache_id"), F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, "put").otherwise("get").alias("op"), (F.col("id") % 5).alias("key"), F.col("id").alias("value"))
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    got = sorted(map(tuple, drained(lru.replay_stream(stream, 2), "lru", "append").collect()), key=str)
    assert got == sorted(map(tuple, lru.replay(log, 2).collect()), key=str)
