"""Strong components, cycles, trees and islands against plain versions."""

import json
import random
import sys

import pytest
from pyspark.sql import functions as F

from millrace.operators import graph
from millrace.plans import fixpoint


def tarjan(edges):
    sys.setrecursionlimit(100_000)
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())
    at, low, stack, on, found = {}, {}, [], set(), {}

    def visit(v):
        at[v] = low[v] = len(at)
        stack.append(v)
        on.add(v)
        for w in out[v]:
            if w not in at:
                visit(w)
                low[v] = min(low[v], low[w])
            elif w in on:
                low[v] = min(low[v], at[w])
        if low[v] == at[v]:
            members = []
            while not members or members[-1] != v:
                members.append(stack.pop())
                on.discard(members[-1])
            found.update(dict.fromkeys(members, min(members)))

    for v in out:
        if v not in at:
            visit(v)
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components(spark, seed):
    rng = random.Random(seed)
    n, m = ((30, 40), (60, 90), (25, 60), (80, 80))[seed]
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    edges += [(100, 101), (101, 102), (102, 100), (200, 201), (201, 202), (202, 200), (202, 203), (203, 204), (204, 202), (300, 301), (301, 300), (400, 400), (5, 500), (500, 501), (501, 5)]
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "src int, dst int")
    assert {r.node: r.component for r in fixpoint.strong_components(df).collect()} == tarjan(edges)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, cuts = 10_000, []
    real = fixpoint.cut
    monkeypatch.setattr(fixpoint, "cut", lambda df, **k: cuts.append(1) or real(df, **k))
    chain = spark.range(n).select(F.lit(1).alias("case_id"), F.col("id").alias("parent"), (F.col("id") + 1).alias("child"))
    ring = spark.range(n).select(F.lit(2).alias("case_id"), F.col("id").alias("parent"), ((F.col("id") + 1) % n).alias("child"))
    got = {r.case_id: r.can_finish for r in graph.can_finish(chain.union(ring)).collect()}
    assert got == {1: True, 2: False} and len(cuts) <= 40


def test_cycles_by_case(spark):
    rng = random.Random(9)
    cases, want = [], {}
    for k in range(12):
        edges = [(a, b) for a, b in ((rng.randrange(12), rng.randrange(12)) for _ in range(9)) if a < b or rng.random() < 0.2]
        cases += [(k, a, b) for a, b in edges]
        parts = tarjan(edges)
        if edges:
            want[k] = len(set(parts.values())) == len(parts) and all(a != b for a, b in edges)
    assert {r.case_id: r.can_finish for r in graph.can_finish(spark.createDataFrame(cases, "case_id int, parent int, child int")).collect()} == want


def test_trees(spark):
    def nested(node, out, top=True):
        kids = [nested(c, out, False) for c in sorted(out.get(node, ()))]
        return {"parent": node, "children": kids} if top else {"role": node, **({"children": kids} if kids else {})}

    layered = [(f"a{i}{j}", f"a{i + 1}{k}") for i in range(6) for j in range(2) for k in range(2)] + [("r", "a00"), ("r", 'q"uote'), (None, "x"), ("alone", None)]
    out = {}
    for p, c in layered:
        if p and c:
            out.setdefault(p, set()).add(c)
    edges = spark.createDataFrame(layered, "parent string, child string")
    roots = spark.createDataFrame([("r",), ("a10",), ("solo",), (None,)], "root string")
    got = {r.root: json.loads(r.tree) for r in graph.tree_json(edges, roots).collect()}
    assert got == {x: nested(x, out) for x in ("r", "a10", "solo")}
    by_path = {r.root: json.loads(r.tree) for r in graph._tree_by_path(edges, roots, 20).collect()}
    assert by_path == got
    cyclic = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "parent string, child string")
    assert json.loads(graph.tree_json(cyclic, spark.createDataFrame([("a",)], "root string")).first().tree) == {"parent": "a", "children": [{"role": "b", "children": [{"role": "c"}]}]}


def plain_islands(cells):
    left, n = set(cells), 0
    while left:
        todo, n = [left.pop()], n + 1
        while todo:
            r, c = todo.pop()
            for x in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if x in left:
                    left.remove(x)
                    todo.append(x)
    return n


@pytest.mark.parametrize("tile", [1, 2, 5, 256])
def test_islands(spark, tile):
    rng = random.Random(tile)
    grids = {g: [(rng.randint(-9, 20), rng.randint(-9, 20)) for _ in range(n)] for g, n in (("dense", 700), ("thin", 200), ("one", 1))}
    df = spark.createDataFrame([(g, r, c) for g, cells in grids.items() for r, c in cells] + [("thin", None, 1)], "grid_id string, r int, c int")
    assert {r.grid_id: r.islands for r in graph.islands(df, tile).collect()} == {g: plain_islands(c) for g, c in grids.items()}


def test_a_large_grid(spark):
    df = spark.range(1_000_000).select(F.lit(1).alias("grid_id"), F.expr("int(id div 1000)").alias("r"), F.expr("int(id % 1000)").alias("c")).where((F.xxhash64("r", "c") % 5) > -2)
    cells = [(r.r, r.c) for r in df.select("r", "c").collect()]
    assert graph.islands(df).first().islands == plain_islands(cells)
