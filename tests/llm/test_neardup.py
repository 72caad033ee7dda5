import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import neardup as nd

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, k):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    where = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            where[x].add(i)
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in sets.items():
        for j in {j for x in s for j in where[x] if j < i}:
            common = len(s & sets[j])
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def result(frame):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in frame.collect()}


def test_against_brute_force_on_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k, percent in ((3, 85), (5, 80)):
        want = brute(rows, k, percent)
        assert result(nd.near_duplicates(docs, k=k, percent=percent)) == want
        assert sum(not v[2] for v in want.values()) > 50
    assert nd.keep_one_each(docs).count() == sum(v[2] for v in brute(rows, 5, 80).values())


def test_chains_of_edits_hot_groups_and_odd_rows(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows, text = [], [rng.choice(words) for _ in range(120)]
    for i in range(150):  # a chain: neighbours are linked, far ones are not
        rows.append((i, " ".join(text)))
        text[rng.randrange(120)] = rng.choice(words)
    long = [rng.choice(words) for _ in range(900)]
    for i in range(150, 210):  # long texts: the one-permutation sketch
        copy = list(long)
        for _ in range(rng.randrange(30)):
            copy[rng.randrange(900)] = rng.choice(words)
        rows.append((i, "\n".join(copy)))
    rows += [(300 + i, "A b  C") for i in range(40)] + [(400, None), (401, ""), (402, " \t\n"), (403, "a B c"), (404, "a b"), (405, "one")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("gone", F.lit("x"))
    assert result(nd.near_duplicates(frame.select("doc_id", "text"))) == brute(rows, 3, 85)
    odd = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "x")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in nd.near_duplicates(odd).collect()), key=str)
    assert got == [(1, 1, True), (1, 1, True), (2, 2, True), (None, None, True)]
    assert nd.near_duplicates(odd.limit(0)).count() == 0
    assert nd.keep_one_each(frame).columns == frame.columns


def test_every_text_of_a_repeated_id_has_its_links(spark):
    rows = [(1, "a b c d e f"), (1, "x y z w v u"), (2, "x y z w v u t"), (3, "a b c d e f g"), (4, "q r s t u v w")]
    for order in (rows, rows[::-1]):
        got = nd.near_duplicates(spark.createDataFrame(order, "doc_id long, text string"), percent=50).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_one_permutation_misses_no_pair_at_the_limit():
    rng = np.random.default_rng(3)
    for n in (12, 20, 50, 200):
        d = next(d for d in range(n) if 100 * (n - d - 1) < 85 * (n + d + 1))  # the most that each may have of its own
        for _ in range(200):
            x = rng.integers(1 << 63, size=n + d, dtype=np.uint64) * np.uint64(2)
            a, b = (nd.band_keys(nd.one_permutation(np.sort(v))[None])[0] for v in (x[:n], np.concatenate((x[: n - d], x[n:]))))
            assert (a == b).any(), n


def test_large_stars_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 5)
    rng = random.Random(8)
    base = [f"w{rng.randrange(300)}" for _ in range(110)]
    rows = []
    for i in range(60):
        copy = list(base)
        for at in rng.sample(range(110), rng.randrange(3, 6)):
            copy[at] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(copy)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 3, 85)
    assert len({v[1] for v in want.values()}) > 1
    assert result(nd.near_duplicates(frame)) == want
