"""Shards of near equal bytes that keep linked documents together: balanced label propagation.

Documents of one group (by default: equal texts) are linked through a node that stands for the group, so a group of n
documents has n edges. Every document has the label of the shard its doc_id hashes to. A group counts its bytes by label and
asks to go where most of them are, among shards that have room; a shard admits groups up to its quota, by ranges of a hash of
the group, whose bounds come from nested histograms; groups that were not admitted ask again, among the shards with room left,
until all are placed. Groups of more than 1/``LARGE`` of a quota are dealt first, the largest first, as they could not be moved
later: there are at most ``LARGE`` times the number of shards of them, so their counts are gathered and dealt in one step. One
that fits no shard's room fills the shard with most room, then the next, by ranges of a hash of its documents. Documents without a
link, which no shard's edges depend on, then fill every shard up to its quota by ranges of a hash.

Law: ``bytes``. Sizes count the UTF-8 bytes of the text plus 1. :func:`edge_cut` counts the edges that end up cut.

Defined cases: null texts have size 1 and are linked with nothing; empty texts are equal; rows with equal doc_id and text go
together; a null doc_id hashes as empty text; rows are numbered in the order of all their columns' hashes within a part, so
ties do not matter; a text of any length counts as one row and is never split; extra columns pass through, and shard and slot
get a trailing underscore if the input has columns of these names; any number of rows, also none, fills all shards as evenly
as its rows allow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import text as tx
from millrace.llm.thresholds import hash60, thresholds
from millrace.plans.checkpoints import cut, release

#: Groups of more than this part of a quota are dealt by themselves.
LARGE = 64
#: Groups that have not been admitted after so many rounds, when every room is nearly used up, go where they hold most.
ROUNDS = 12
#: Rows that one task numbers, about.
NUMBERED = 100_000


def deal_large(groups: list[tuple[str, dict[int, int]]], capacity: float, shards: int) -> tuple[dict[str, list[tuple[int, float]]], list[float]]:
    """Shards of large groups, each with the bytes it takes of them (the last one what is left), and every shard's room after
    that. groups: (group, bytes by label)."""
    room, dealt = [capacity] * shards, {}
    for group, held in sorted(groups, key=lambda g: (-sum(g[1].values()), g[0])):
        left = float(sum(held.values()))
        fits = [s for s in range(shards) if room[s] >= left]
        dealt[group] = []
        while left > 0:
            to = max(fits or range(shards), key=lambda s: (held.get(s, 0), room[s], -s) if fits else (room[s], held.get(s, 0), -s))
            part = left if fits or room[to] <= 0 else min(left, room[to])
            dealt[group].append((to, part))
            room[to] -= part
            left -= part
    return dealt, room


def _large(start: DataFrame, held: DataFrame, totals: DataFrame, capacity: float, shards: int) -> tuple[DataFrame, list[float]]:
    """Documents of large groups with their shard, and the room left."""
    large = totals.where(F.col("total") > capacity / LARGE).select("group")
    counts: dict[str, dict[int, int]] = {}
    for r in held.join(F.broadcast(large), "group").collect():  # at most LARGE * shards groups
        counts.setdefault(r.group, {})[r.shard] = r.size
    dealt, room = deal_large(list(counts.items()), capacity, shards)
    rows = [(g, i, to, sum(p for _, p in parts[: i + 1])) for g, parts in dealt.items() for i, (to, _) in enumerate(parts)]
    spark = start.sparkSession
    whole = spark.createDataFrame([(r[0], r[2]) for r in rows if len(dealt[r[0]]) == 1], "group string, to int")
    split = spark.createDataFrame([r for r in rows if len(dealt[r[0]]) > 1], "group string, nth int, to int, budget double")
    items = start.join(F.broadcast(split.select("group").distinct()), "group").select(F.col("group").alias("stream"), hash60(F.col("doc_id")).alias("hash"), "size")
    limits = thresholds(items, split.select(F.col("group").alias("stream"), "budget")).withColumnRenamed("stream", "group") if any(len(d) > 1 for d in dealt.values()) else split.select("group", "budget", F.lit(0).cast("long").alias("limit"))
    bounds = split.join(F.broadcast(limits), ["group", "budget"], "left").groupBy("group").agg(F.array_sort(F.collect_list(F.struct("nth", F.coalesce("limit", F.lit(1 << 60)).alias("limit"), "to"))).alias("bounds"))
    of_part = F.element_at(F.filter("bounds", lambda b: hash60(F.col("doc_id")) < b["limit"]), 1)["to"]
    columns = start.drop("shard").columns
    one = start.join(F.broadcast(whole), "group").select(*columns, F.col("to").alias("shard"))
    more = start.join(F.broadcast(bounds), "group").select(*columns, of_part.alias("shard"))
    return one.union(more), room


def propagate(linked: DataFrame, capacity: float, shards: int) -> DataFrame:
    """linked: (doc_id, group, size, ...); with shard."""
    start = cut(linked.withColumn("shard", (hash60(F.col("doc_id")) % shards).cast("int")))
    held = cut(start.groupBy("group", "shard").agg(F.sum("size").alias("size")))
    totals = cut(held.groupBy("group").agg(F.sum("size").alias("total"), F.map_from_entries(F.collect_list(F.struct("shard", "size"))).alias("held")))
    placed, room = _large(start, held, totals, capacity, shards)
    open_groups = cut(totals.where(F.col("total") <= capacity / LARGE))
    found = []
    for step in range(ROUNDS + 1):
        if open_groups.isEmpty():
            break
        last = step == ROUNDS or not any(r > 0 for r in room)
        rooms = F.array(*(F.lit(s) for s in range(shards) if last or room[s] > 0))
        choice = F.array_max(F.transform(rooms, lambda s: F.struct(F.coalesce(F.try_element_at("held", s), F.lit(0).cast("long")).alias("bytes"), F.xxhash64("group", s).alias("tie"), s.alias("to"))))["to"]
        asks = cut(open_groups.withColumn("to", choice))
        wanted = {r.to: r.n for r in asks.groupBy("to").agg(F.sum("total").alias("n")).collect()}  # one row a shard
        tight = [s for s, n in wanted.items() if n > room[s] and not last]
        going = asks
        if tight:
            budgets = start.sparkSession.createDataFrame([(s, max(room[s], 0.0)) for s in tight], "stream int, budget double")
            items = asks.where(F.col("to").isin(tight)).select(F.col("to").alias("stream"), hash60(F.col("group")).alias("hash"), F.col("total").alias("size"))
            limits = {r.stream: r.limit for r in thresholds(items, budgets, levels=2).collect()}  # one row a shard
            limit = F.create_map(*(F.lit(x) for s in tight for x in (s, limits.get(s, 1 << 60))))
            goes = F.coalesce(hash60(F.col("group")) < F.try_element_at(limit, F.col("to")), F.lit(True))
            going = asks.where(goes)
            rest = cut(asks.where(~goes).drop("to"))
        going = cut(going.select("group", "to", "total"))
        for r in going.groupBy("to").agg(F.sum("total").alias("n")).collect():
            room[r.to] -= r.n
        for s in tight:  # what a shard did not admit would not fit there later either
            room[s] = min(room[s], 0.0)
        found.append(going.select("group", "to"))
        release(open_groups)
        release(asks)
        if not tight:
            break
        open_groups = rest
    where = found[0] if found else totals.where("false").select("group", F.lit(0).alias("to"))
    for more in found[1:]:
        where = where.union(more)
    few = totals.where(F.col("total") > capacity / LARGE).select("group")  # their documents are placed; not to meet by their group
    small_ones = start.join(F.broadcast(few), "group", "left_anti").join(where, "group").select(*linked.columns, F.col("to").alias("shard"))
    out = cut(placed.select(*linked.columns, "shard").union(small_ones))
    for done in (start, held, totals):
        release(done)
    return out


def edge_cut(assigned: DataFrame) -> DataFrame:
    """(edges, cut): documents of groups of several, each linked with its group's node, and those in another shard than the
    node, which is where most of the group's bytes are."""
    held = assigned.where("group is not null").groupBy("group", "shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    groups = held.groupBy("group").agg(F.sum("n").alias("edges"), F.max(F.struct("bytes", "n")).alias("m")).where("edges > 1")
    return groups.agg(F.coalesce(F.sum("edges"), F.lit(0)).alias("edges"), F.coalesce(F.sum(F.col("edges") - F.col("m.n")), F.lit(0)).alias("cut"))


def assign(rows: DataFrame, shards: int = 8) -> DataFrame:
    """rows: (doc_id, group, size, ...), group null where nothing is linked; with shard."""
    rows = cut(rows)
    total = rows.agg(F.sum("size")).first()[0] or 0
    capacity = total / shards
    several = rows.where("group is not null").groupBy("group").agg(F.count("*").alias("_n")).where("_n > 1").select("group")
    linked = propagate(rows.join(several, "group", "left_semi").select(*rows.columns), capacity, shards)
    free = rows.join(several, "group", "left_anti").withColumn("hash", hash60(F.col("doc_id")))
    load = {r[0]: r[1] for r in linked.groupBy("shard").agg(F.sum("size")).collect()}  # one row a shard
    lack = [max(0.0, capacity - load.get(s, 0)) for s in range(shards)]
    left = total - sum(load.values())
    scale = left / sum(lack) if sum(lack) else 0.0
    bounds, so_far = [], 0.0
    for s in range(shards - 1):
        so_far += lack[s] * scale
        bounds.append((s, so_far))
    values = ", ".join(f"({0 * i}, {b!r}D)" for i, (_, b) in enumerate(bounds or [(0, 0.0)]))
    budgets = rows.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(stream, budget)")
    limits = thresholds(free.select(F.lit(0).alias("stream"), "hash", "size"), budgets.distinct())
    limits = {r.budget: r.limit for r in limits.select("budget", "limit").collect()}  # fewer rows than shards
    shard = F.lit(shards - 1)
    for s, b in reversed(bounds):
        shard = F.when(F.col("hash") < limits.get(b, 1 << 60), s).otherwise(shard)
    return linked.select(*rows.columns, "shard").union(free.select(*rows.columns, shard.cast("int").alias("shard")))


def numbered(rows: DataFrame, by: str = "shard", order: str = "doc_id") -> DataFrame:
    """With slot: 0, 1, ... within each shard; one task numbers a part of a shard, and parts follow each other."""
    rows = cut(rows)
    parts = max(1, rows.count() // NUMBERED)
    of_row = F.xxhash64(*rows.columns)  # not of the order's column alone, which may be null in many rows
    rows = rows.withColumns({"_hash": of_row, "_part": F.pmod(of_row, F.lit(parts)).cast("int")})
    within = F.row_number().over(Window.partitionBy(by, "_part").orderBy(order, "_hash"))
    sizes = rows.groupBy(by, "_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = rows.withColumn("_within", within).join(before.drop("_n"), [by, "_part"])
    return out.withColumn("slot", (F.col("_before") + F.col("_within") - 1).cast("long")).drop("_part", "_within", "_before", "_hash")


def described(docs: DataFrame):
    return docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("group"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """``docs`` with shard and slot."""
    where = numbered(assign(described(docs), shards)).select(F.col("doc_id").alias("id"), "group", "shard", "slot")
    # rows that agree in doc_id and text share a shard; deal their slots out among them
    alike = Window.partitionBy("id", "group")
    where = where.withColumn("k", F.row_number().over(alike.orderBy("slot")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("group"))
    rows = rows.withColumn("k", F.row_number().over(alike.orderBy("id")))
    same = rows["id"].eqNullSafe(where["id"]) & rows["group"].eqNullSafe(where["group"]) & (rows["k"] == where["k"])
    names = tx.extended(docs, "shard int, slot long").names[-2:]
    return rows.join(where, same).select(*(F.col("row")[c].alias(c) for c in docs.columns), F.col("shard").alias(names[0]), F.col("slot").alias(names[1]))


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = numbered(assign(described(docs)))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op9_sharding": op9_sharding}
