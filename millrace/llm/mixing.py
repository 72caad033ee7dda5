"""Mixing sources to target weights by hash thresholds.

A source's target is its weight's share of all words, at most ``MOST`` times its own words; what a cap leaves over is shared
again by weight. A document is taken as often as its source's target holds the source whole, and once more if its hash is
below the threshold that meets the rest of the target. The hash depends on doc_id alone, so a rerun takes the same, and a
larger target takes a superset.

Sources are few: what runs in one task, or is joined by broadcast, is one row a source.

Defined cases: a null or wordless text has size 0 and is never counted; a null source is a source of its own, the last; rows
with equal doc_id are taken alike; a null doc_id hashes by its text, so that only equal texts are taken alike; a text of any
length is one item; without rows there are no targets; extra columns pass through :func:`mix` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.thresholds import hash60, thresholds
from millrace.plans.checkpoints import cut

WEIGHTS = (1, 2, 3)
MOST = 3


def n_words(column):
    return F.coalesce(F.regexp_count(column, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def row_hash(doc_id="doc_id", text="text"):
    """Of doc_id alone where there is one, else of the text."""
    return hash60(F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text "), F.coalesce(text, F.lit("")))))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from rows of (source, size). Windows here run over one row a source."""
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("double"))
    per = per.withColumn("cap", (most * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    per = per.withColumn("weight_left", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    per = per.withColumn("total", F.sum("source_size").over(Window.partitionBy()).cast("double"))
    free = F.col("cap") * F.col("weight_left") > (F.col("total") - F.col("capped_before")) * F.col("weight")
    per = per.withColumn("place", F.row_number().over(order))
    per = per.withColumn("first", F.min(F.when(free, F.struct("place", "capped_before", "weight_left"))).over(Window.partitionBy()))
    is_free = F.col("place") >= F.col("first.place")
    target = F.when(F.col("first").isNull() | ~is_free, F.col("cap")).otherwise(F.col("weight") * (F.col("total") - F.col("first.capped_before")) / F.col("first.weight_left"))
    return per.select("source", "source_size", target.alias("target"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, hash) of each row, and (source, source_size, target, times, limit) of each source."""
    sized = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), row_hash().alias("hash")))
    goal = targets(sized, weights, most).withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    name = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    goal = cut(goal.withColumn("budget", F.col("target") - F.col("times") * F.col("source_size")).withColumn("stream", name))
    limits = thresholds(sized.select(name.alias("stream"), "hash", "size"), goal.select("stream", "budget")).select("stream", "limit")
    known = goal.join(limits, "stream", "left")
    return sized, cut(known.select("source", "source_size", "target", "times", F.coalesce("limit", F.lit(0)).alias("limit")))


def shares(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, times, taken for each row of ``docs`` (doc_id, source, text)."""
    sized, known = plan(docs, weights, most)
    out = sized.join(known.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    times = (F.col("times") + F.when(F.col("hash") < F.col("limit"), 1).otherwise(0)).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    _, known = plan(docs, weights, most)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("source").alias("of"), row_hash().alias("hash"))
    rows = rows.join(known.select("source", "times", "limit"), F.col("of").eqNullSafe(F.col("source")))
    times = F.col("times") + F.when(F.col("hash") < F.col("limit"), 1).otherwise(0)
    rows = rows.where(times > 0).select("row", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return shares(docs).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text ' || coalesce(text, ''))), 1, 15))::BIGINT AS hash
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, (3 * source_size)::DOUBLE AS cap FROM s),
o AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped_before,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left,
         row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place,
         (SELECT sum(source_size)::DOUBLE FROM s) AS total
  FROM w),
f AS (SELECT min(place) AS p, arg_min(capped_before, place) AS cb, arg_min(weight_left, place) AS wl FROM o WHERE cap * weight_left > (total - capped_before) * weight),
t AS (
  SELECT source, source_size, CASE WHEN p IS NULL OR place < p THEN cap ELSE weight * (total - cb) / wl END AS target
  FROM o, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM t),
c AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.times, e.target - e.times * e.source_size AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash)::BIGINT AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.hash)::BIGINT AS own
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       size * (times + CASE WHEN upto <= budget OR (upto - own <= budget AND upto - budget < budget - (upto - own)) THEN 1 ELSE 0 END) AS taken
FROM c
"""

QUERIES = {"op7_mixing": op7_mixing}
SQL = {"op7_mixing": OP7_SQL}
