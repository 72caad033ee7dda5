"""Spelling and the fuzzy join against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import fuzzy, strings


def edits(a, b, near=frozenset()):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [row[0] + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (0 if x == y else 0.5 if x + y in near else 1)))
        row = new
    return row[-1]


def words(rng, n, letters="asdqwe", longest=30):
    out = {"".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 14, 15, 17, 18, 24, longest]))) for _ in range(n)}
    for w in list(out):
        w = list(w)
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randint(0, 1)] = rng.choice(["", *letters])
        out.add("".join(w))
    return sorted(out)


@pytest.mark.parametrize("reach", [1, 3])
def test_candidates_hold_all_near_pairs(spark, reach):
    rng = random.Random(reach)
    asked, known = words(rng, 60), words(rng, 60)
    known += [w + "x" for w in asked[::3]] + [w[1:] for w in asked[1::3]]
    got = {tuple(r) for r in fuzzy.near_words(spark.createDataFrame([(w,) for w in asked], "word string"), spark.createDataFrame([(w,) for w in set(known)], "suggestion string"), reach).collect()}
    assert {(a, b) for a in asked for b in known if edits(a, b) <= reach} <= got


@pytest.mark.parametrize("weighted", [True, False])
def test_suggestions_against_all_pairs(spark, weighted):
    rng = random.Random(4)
    known = {w: rng.randint(1, 3) for w in words(rng, 50, longest=16)} | {"Total": 2}
    asked = words(rng, 25, longest=16) + ["total", "", *list(known)[:3]]
    near = frozenset(fuzzy.key_neighbours()) if weighted else frozenset()
    fold = str.lower if weighted else str
    want = set()
    for q in set(asked):
        if q in known:
            want.add((q, q, 0.0, 1))
            continue
        found = sorted((d, -f, w) for w, f in known.items() if (d := float(edits(fold(q), fold(w), near))) <= 3)
        want |= {(q, w, d, i + 1) for i, (d, _, w) in enumerate(found[:5])}
    frame = spark.createDataFrame([(w,) for w in [*asked, None]], "word string")
    got = {tuple(r) for r in fuzzy.suggest(frame, spark.createDataFrame(list(known.items()), "word string, frequency long"), weighted=weighted).collect()}
    assert got == want


def plain_tokens(name):
    import re

    return sorted({t for t in re.split(r"\s+", re.sub(r"[^\w\s]", " ", name.lower())) if t and t not in fuzzy.STOP_WORDS})


def plain_block(name):
    import re

    return "".join(t for t in re.split(r"\s+", re.sub(r"[^\w\s]", " ", name.lower())) if t and t not in fuzzy.STOP_WORDS)[:2]


def plain_score(a, b):
    match = lambda x, y: x == y or (abs(len(x) - len(y)) <= 3 and edits(x, y) <= max(1, max(len(x), len(y)) // 4))
    free, n = list(b), 0
    for x in a:
        fits = [y for y in free if match(x, y)]
        if fits:
            free.remove(fits[0])
            n += 1
    return n / len(set(a) | set(b)) if a and b else 0.0


@pytest.mark.parametrize("rows", [2048, 3])
def test_fuzzy_join_against_all_pairs(spark, rows):
    rng = random.Random(7)
    stems = ["acme", "acorn", "alpine", "b a", "ba", "miller", "trading", "north star", "norths", "Inc.", "the", "Öl"]
    name = lambda: " ".join(rng.choice(stems) + rng.choice(["", "", "s", "x"]) for _ in range(rng.randint(1, 4))) + rng.choice(["", ", Inc.", " LLC"])
    lefts = [(i, name()) for i in range(40)] + [(100, "AB Miller Trading"), (101, "..."), (102, "zzz")]
    rights = [(i, name()) for i in range(50)] + [(200, "A.B. Miller Trading"), (201, "??")]
    want = []
    taken = set()
    for i, n in lefts:
        scored = sorted((-plain_score(plain_tokens(n), plain_tokens(m)), j, m) for j, m in rights if plain_block(n) and plain_block(n) == plain_block(m))
        s, j, m = scored[0] if scored else (-0.0, None, None)
        hit = -s >= 0.55
        taken |= {j} if hit else set()
        want.append((i, n, j if hit else None, m if hit else None, -s + 0.0, "matched" if hit else "left_only"))
    want += [(None, None, j, m, 0.0, "right_only") for j, m in rights if j not in taken]
    out = fuzzy.fuzzy_join(spark.createDataFrame(lefts, "left_id int, name string"), spark.createDataFrame(rights, "right_id int, name string"), block_rows=rows)
    got = [tuple(r) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert (100, "AB Miller Trading", 200, "A.B. Miller Trading", 0.6666666666666666, "matched") in got or any(r[0] == 100 and r[2] == 200 for r in got)


def test_segmentable(spark):
    rng = random.Random(2)
    known = ["a", "ab", "bab", "cc", "abc", ""]
    texts = [("".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))) for _ in range(60)]

    def breaks(s):
        ok = [True] + [False] * len(s)
        for i in range(len(s)):
            if ok[i]:
                for w in known:
                    if w and s.startswith(w, i):
                        ok[i + len(w)] = True
        return ok[-1]

    frame = spark.createDataFrame([*enumerate(texts), (99, None), (None, "ab")], "id int, s string")
    got = {r.id: r.breaks for r in strings.segmentable(frame, spark.createDataFrame([(w,) for w in [*known, None]], "word string")).collect()}
    assert got == dict(enumerate(map(breaks, texts))) | {99: False, None: True}
    assert [r.breaks for r in strings.segmentable(frame.where("id < 3"), spark.createDataFrame([], "word string")).orderBy("id").collect()] == [t == "" for t in texts[:3]]
