"""Iterating a DataFrame to a fixpoint, with lineage cut each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.checkpoints import cut, release


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node that can be reached.

    Alternates the "large star" and "small star" rewrites of an edge list, which halve path lengths and keep the number
    of edges linear, until the list is a set of stars round the smallest nodes. The least neighbour of a hub is pre-aggregated,
    but its edges are joined to it by the hub's key; adaptive execution splits such a join where it is skewed. Nulls are
    ignored; a self loop is a node by itself.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    nodes_alone = pairs.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    now = cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        if now.isEmpty():
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = cut(small.select("e.u", "e.v").where("u <> v").distinct())
        sums = [d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for d in (now, new)]
        release(now)
        now = new
        if sums[0] == sums[1]:
            break
    else:
        raise RuntimeError(f"no fixpoint within {max_rounds} rounds")
    linked = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = linked.select(F.col("component").alias("node"), "component").distinct()
    return linked.union(roots).union(nodes_alone).groupBy("node").agg(F.min("component").alias("component"))


def _inside(edges: DataFrame) -> DataFrame:
    """Edges that go on at both ends: no cycle has any other."""
    return edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u", "v")


def _chains(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Nodes with one edge in and one out, taken out of their chains by pointer doubling.

    Returns the edges left, (node, first, last): the chain's neighbours at either end of each node taken out, and (node, m) of
    the nodes of rings, which have no ends, with the least node of the ring; None if there is no such node.
    """
    into = edges.groupBy("v").agg(F.min("u").alias("before"), F.count("*").alias("n")).where("n = 1")
    out = edges.groupBy("u").agg(F.min("v").alias("after"), F.count("*").alias("n")).where("n = 1")
    inner = cut(into.select(F.col("v").alias("node"), "before").join(out.select(F.col("u").alias("node"), "after"), "node"))
    n = inner.count()
    if not n:
        release(inner)
        return None
    names = inner.select(F.col("node").alias("k"))
    onward = inner.join(names, F.col("after") == F.col("k"), "left").select("node", F.coalesce("k", "node").alias("to"), F.col("k").isNull().alias("end"), F.col("node").alias("m"))
    now = cut(onward)
    state = None
    for _ in range(n.bit_length() + 1):
        ahead = now.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("end").alias("end2"), F.col("m").alias("m2"))
        new = cut(now.where("not end").join(ahead, "to").select("node", F.col("to2").alias("to"), F.col("end2").alias("end"), F.least("m", "m2").alias("m")).union(now.where("end").select("node", "to", "end", "m")))
        release(now)
        now = new
        before, state = state, now.where("not end").agg(F.count("*"), F.sum(F.xxhash64("node", "m").cast("decimal(38,0)"))).first()
        if not state[0] or state == before:  # each round ends some node of every chain, or lowers a least node of a ring
            break
    ended = now.where("end").select("node", F.col("to").alias("tail"))
    rings = now.where("not end").select("node", "m")
    # a chain is known by its last node; its first node is the one whose predecessor is not inner
    heads = inner.join(names, F.col("before") == F.col("k"), "left_anti").select("node", "before").join(ended, "node").select("tail", F.col("before").alias("first"))
    spans = heads.join(inner.select(F.col("node").alias("tail"), F.col("after").alias("last")), "tail")
    taken = cut(ended.join(spans, "tail").select("node", "first", "last"))
    rest = edges.join(inner.select(F.col("node").alias("u")), "u", "left_anti").join(inner.select(F.col("node").alias("v")), "v", "left_anti").select("u", "v")
    left = cut(rest.union(spans.select(F.col("first").alias("u"), F.col("last").alias("v")).where("u <> v")).distinct())
    rings = cut(rings)
    release(inner)
    release(now)
    return left, taken, rings


def _least_ancestor(edges: DataFrame, max_rounds: int) -> DataFrame:
    """(node, c): the least node from which each node can be reached, itself included; labels of labels shorten the way."""
    now = cut(edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().withColumn("c", F.col("node")))
    for _ in range(max_rounds):
        offered = edges.join(now.select(F.col("node").alias("u"), "c"), "u").select(F.col("v").alias("node"), "c")
        least = cut(now.union(offered).groupBy("node").agg(F.min("c").alias("c")))
        new = cut(least.join(least.select(F.col("node").alias("c"), F.col("c").alias("d")), "c").select("node", F.col("d").alias("c")))
        still = new.join(now.withColumnRenamed("c", "old"), "node").where("c <> old").isEmpty()
        release(now)
        release(least)
        now = new
        if still:
            return now
    raise RuntimeError(f"no fixpoint within {max_rounds} rounds")


def strong_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 1000) -> DataFrame:
    """(node, component) for every node of ``edges``: the least node of those that it reaches and that reach it.

    Forward and backward reach with trimming: edges that don't go on at both ends are dropped; chains of nodes with one edge in
    and one out are contracted by pointer doubling, so a chain of n nodes takes log n rounds; then every node gets the least
    node that reaches it, and, among nodes of one such label, the least that it reaches: where both agree, the component is
    found. Its edges and those between labels go, and the rest is done again. Contracted nodes follow last: they belong where
    both ends of their chain belong together. Nulls are ignored; nodes may be of any type that can be ordered.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    now = cut(pairs.where("u <> v").distinct())
    found: list[DataFrame] = []
    contracted: list[DataFrame] = []
    for _ in range(max_rounds):
        n = now.count()
        if not n:
            break
        trimmed = cut(_inside(_inside(now)))
        left = trimmed.count()
        if not left:
            break
        chains = _chains(trimmed)
        if chains is not None:
            now, taken, rings = chains
            found.append(rings.select("node", F.col("m").alias("component")))
            contracted.append(taken)
            release(trimmed)
            continue
        release(now)
        if left < n:
            now = trimmed
            continue
        forward = _least_ancestor(trimmed, max_rounds)
        label = lambda side: forward.select(F.col("node").alias(side), F.col("c").alias(f"c{side}"))
        within = cut(trimmed.join(label("u"), "u").join(label("v"), "v").where("cu = cv").select("u", "v"))
        backward = _least_ancestor(within.select(F.col("v").alias("u"), F.col("u").alias("v")), max_rounds)
        whole = cut(forward.join(backward.withColumnRenamed("c", "d"), "node").where("c = d").select("node", F.col("c").alias("component")))
        found.append(whole)
        gone = lambda side: whole.select(F.col("node").alias(side))
        now = cut(within.join(gone("u"), "u", "left_anti").join(gone("v"), "v", "left_anti").select("u", "v"))
        for frame in (trimmed, forward, within, backward):
            release(frame)
    else:
        raise RuntimeError(f"no fixpoint within {max_rounds} rounds")
    known = nodes.where("false").select("node", F.col("node").alias("component"))
    for frame in found:
        known = known.union(frame)
    for taken in reversed(contracted):
        known = cut(known)
        name = lambda side: known.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))  # noqa: B023, E731
        ends = taken.join(name("first"), "first", "left").join(name("last"), "last", "left").withColumn("a", F.coalesce("c_first", "first")).withColumn("b", F.coalesce("c_last", "last"))
        added = ends.where("a = b").select(F.explode(F.array("node", "first")).alias("node"), F.col("a").alias("component"))
        known = known.union(added).distinct()
    known = cut(known)
    least = known.groupBy("component").agg(F.min("node").alias("least"))
    return nodes.join(known.join(least, "component").select("node", "least"), "node", "left").select("node", F.coalesce("least", "node").alias("component"))


def nodes_of_cycles(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 1000) -> DataFrame:
    """(node): of every part of the graph that has a cycle, at least one node that is on one or between two.

    Trimming and contracting alone: where neither goes on, every node left has an edge in and one out, so each leads into a
    cycle and comes from one.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    found = pairs.where("u = v").select(F.col("u").alias("node"))
    now = cut(pairs.where("u <> v").distinct())
    n = now.count()
    for _ in range(max_rounds):
        trimmed = cut(_inside(_inside(now)))
        left = trimmed.count()
        release(now)
        if not left:
            return found
        chains = _chains(trimmed)
        if chains is not None:
            now, taken, rings = chains
            found = found.union(rings.select("node")).union(taken.where("first = last").select("node"))
            release(trimmed)
            n = now.count()
        elif left == n:
            return found.union(trimmed.select(F.col("u").alias("node")))
        else:
            now, n = trimmed, left
    raise RuntimeError(f"no fixpoint within {max_rounds} rounds")
