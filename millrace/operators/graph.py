"""Role graphs and other directed graphs kept as (parent, child) edges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.checkpoints import cut, release
from millrace.plans.fixpoint import connected_components, nodes_of_cycles


def prefix_roots(names: DataFrame, column: str, prefix: str, ignore_case: bool = True) -> DataFrame:
    """(root): distinct names that start with ``prefix``; from edges or, to include childless roles, from the role list."""
    c, p = (F.upper(column), prefix.upper()) if ignore_case else (F.col(column), prefix)
    return names.where(c.startswith(p)).select(F.col(column).alias("root")).distinct()


def top_roots(edges: DataFrame) -> DataFrame:
    """(root): parents that are nobody's child. A component that is only a cycle has none."""
    return edges.select(F.col("parent").alias("root")).where("root is not null").distinct().join(edges.select(F.col("child").alias("root")), "root", "left_anti")


def simple_paths(edges: DataFrame, roots: DataFrame, max_depth: int = 20) -> DataFrame:
    """(root, node, depth, path): every path without repeated nodes from each root, the root itself included.

    Levels are written one by one, so neither the number of paths nor the depth meets the limits of a recursive query, and
    the graph's edges are read once a level. It ends at ``max_depth``, or where no path goes on.
    """
    steps = cut(edges.select(F.col("parent").alias("node"), "child").where("node is not null and child is not null").distinct())
    level = cut(roots.select("root").where("root is not null").distinct().select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.array("root").alias("path")))
    levels = [level]
    while len(levels) <= max_depth:
        onward = level.join(steps, "node").where(~F.array_contains("path", F.col("child")))
        level = cut(onward.select("root", F.col("child").alias("node"), (F.col("depth") + 1).alias("depth"), F.array_append("path", F.col("child")).alias("path")))
        if level.isEmpty():
            break
        levels.append(level)
    release(steps)
    out = levels[0]
    for more in levels[1:]:
        out = out.union(more)
    return out


def leaf_map(edges: DataFrame, roots: DataFrame | None = None, max_depth: int = 20) -> DataFrame:
    """(root, leaf): the childless nodes that each root reaches."""
    paths = simple_paths(edges, top_roots(edges) if roots is None else roots, max_depth)
    return paths.where("depth > 0").join(edges.select(F.col("parent").alias("node")), "node", "left_anti").select("root", F.col("node").alias("leaf")).distinct()


def multi_parent(edges: DataFrame) -> DataFrame:
    """(child, parents): children of more than one parent."""
    return edges.groupBy("child").agg(F.count_distinct("parent").alias("parents")).where("parents > 1")


_QUOTE = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r'^\{"x":(.*)\}$', 1)


def tree_json(edges: DataFrame, roots: DataFrame | None = None, max_depth: int = 20) -> DataFrame:
    """(root, tree): nested JSON ``{"parent", "children": [{"role", "children"?}]}``; leaves have no children key.

    Folds the graph by node, from the leaves up: a node's text is built once, when those of all its children are there, however
    many paths lead to it. Graphs with cycles, or deeper than ``max_depth``, where a node's text depends on the path to it, are
    folded by path instead.
    """
    roots = (top_roots(edges) if roots is None else roots).select("root").where("root is not null").distinct()
    steps = cut(edges.select(F.col("parent").alias("p"), F.col("child").alias("c")).where("p is not null and c is not null").distinct())
    nodes = roots.select(F.col("root").alias("node")).union(steps.select("p")).union(steps.select("c")).distinct()
    leaf = F.concat(F.lit('{"role":'), _QUOTE("node"), F.lit("}"))
    done = cut(nodes.join(steps.select(F.col("p").alias("node")), "node", "left_anti").select("node", leaf.alias("text"), F.lit(None).cast("string").alias("kids")))
    texts, total, n = [done], nodes.count(), done.count()
    known = done
    for _ in range(max_depth):
        if n == total:
            break
        # nodes all of whose children are known, and that are not known themselves
        told = steps.join(known.select(F.col("node").alias("c"), "text"), "c", "left").join(known.select(F.col("node").alias("p")), "p", "left_anti")
        kids = told.groupBy(F.col("p").alias("node")).agg(F.bool_and(F.col("text").isNotNull()).alias("all"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "text"))), lambda x: x["text"]), ",").alias("kids")).where("all")
        level = cut(kids.select("node", F.concat(F.lit('{"role":'), _QUOTE("node"), F.lit(',"children":['), "kids", F.lit("]}")).alias("text"), "kids"))
        more = level.count()
        if not more:
            break
        n += more
        texts.append(level)
        known = known.union(level)
    if n < total:
        for frame in (steps, *texts):
            release(frame)
        return _tree_by_path(edges, roots, max_depth)
    release(steps)
    return known.join(roots.withColumnRenamed("root", "node"), "node", "left_semi").select(
        F.col("node").alias("root"), F.concat(F.lit('{"parent":'), _QUOTE("node"), F.lit(',"children":['), F.coalesce("kids", F.lit("")), F.lit("]}")).alias("tree"))


def _tree_by_path(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    paths = cut(simple_paths(edges, roots, max_depth))
    deepest = paths.agg(F.max("depth")).first()[0] or 0
    below = None
    for depth in range(deepest, -1, -1):
        level = paths.where(F.col("depth") == depth)
        level = level.withColumn("kids", F.lit(None).cast("string")) if below is None else level.join(below, ["root", "path"], "left")
        kids = F.when(F.col("kids").isNotNull(), F.concat(F.lit(',"children":['), "kids", F.lit("]")))
        if depth == 0:
            empty = F.coalesce(kids, F.lit(',"children":[]'))
            return level.select("root", F.concat(F.lit('{"parent":'), _QUOTE("node"), empty, F.lit("}")).alias("tree"))
        text = F.concat(F.lit('{"role":'), _QUOTE("node"), F.coalesce(kids, F.lit("")), F.lit("}"))
        above = level.select("root", F.slice("path", 1, depth).alias("path"), "node", text.alias("text"))
        below = above.groupBy("root", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "text"))), lambda x: x["text"]), ",").alias("kids"))
    raise AssertionError("unreachable")


def _label_tile(cells: pd.DataFrame, tile: int) -> pd.DataFrame:
    """The cells at a tile's sides and one of each island, with the island's first cell (lr, lc) within the tile."""
    at = sorted(set(zip(cells["r"].tolist(), cells["c"].tolist(), strict=True)))
    parent = {x: x for x in at}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for r, c in at:
        for near in ((r - 1, c), (r, c - 1)):
            if near in parent:
                a, b = find((r, c)), find(near)
                parent[max(a, b)] = min(a, b)
    rows = [(*x, *find(x)) for x in at if x[0] % tile in (0, tile - 1) or x[1] % tile in (0, tile - 1) or parent[x] == x]
    out = pd.DataFrame(rows, columns=["r", "c", "lr", "lc"], dtype="int64")
    out.insert(0, "grid_id", cells["grid_id"].iloc[0])
    return out


def islands(cells: DataFrame, tile: int = 256) -> DataFrame:
    """(grid_id, islands) from land cells (grid_id, r, c): groups of cells that touch at their sides.

    Grids are cut into tiles of ``tile`` by ``tile`` cells, each joined up by itself; only cells at the sides of tiles meet
    across them, and only the islands of tiles that do are brought to components. Cells may repeat; nulls are left out.
    """
    land = cells.select("grid_id", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).where("grid_id is not null and r is not null and c is not null")
    schema = f"grid_id {land.schema['grid_id'].dataType.simpleString()}, r long, c long, lr long, lc long"
    sides = cut(land.groupBy("grid_id", F.floor(F.col("r") / tile), F.floor(F.col("c") / tile)).applyInPandas(lambda g: _label_tile(g[["grid_id", "r", "c"]], tile), schema))
    name = lambda g, r, c: F.struct(F.col(g).alias("g"), F.col(r).alias("r"), F.col(c).alias("c"))
    here = sides.select("grid_id", "r", "c", name("grid_id", "lr", "lc").alias("src"))
    across = lambda d, e, at: sides.where(F.pmod(F.col(at), F.lit(tile)) == 0).select("grid_id", (F.col("r") - d).alias("r"), (F.col("c") - e).alias("c"), name("grid_id", "lr", "lc").alias("dst"))
    links = here.join(across(1, 0, "r").union(across(0, 1, "c")), ["grid_id", "r", "c"]).select("src", "dst").distinct()
    joined = connected_components(links)
    alone = sides.where("r = lr and c = lc").select(name("grid_id", "lr", "lc").alias("node"))
    whole = alone.join(joined, "node", "left").select(F.coalesce("component", "node").alias("component")).distinct()
    return whole.groupBy(F.col("component.g").alias("grid_id")).agg(F.count("*").alias("islands"))


def can_finish(edges: DataFrame, by: str = "case_id", before: str = "parent", after: str = "child") -> DataFrame:
    """(by, can_finish): whether each case's graph has no cycle. Null ends are ignored; the null case always can."""
    cases = edges.select(by).distinct()
    key = lambda c: F.struct(F.col(by).alias("by"), F.col(c).alias("node"))
    live = edges.where(F.col(before).isNotNull() & F.col(after).isNotNull() & F.col(by).isNotNull())
    stuck = nodes_of_cycles(live.select(key(before).alias("src"), key(after).alias("dst"))).select(F.col("node.by").alias(by)).distinct()
    return cases.join(stuck.withColumn("_stuck", F.lit(True)), by, "left").select(by, F.col("_stuck").isNull().alias("can_finish"))
