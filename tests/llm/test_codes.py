"""Vector codes against plain loops over whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from millrace.llm import codes

SF = "/root/testdata/sf0.001"


def brute(rows, entries=256, rounds=4):
    """rows: (id, vector, label), all kept and of one length; (id, code, error, label_error, digest) of each, sorted."""
    whole = [[math.floor(1024 * x) for x in v] for _, v, _ in rows]
    width = len(whole[0]) // 4
    part = lambda v, p: v[p * width : (p + 1) * width]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    books = [[part(whole[i], p) for i in order] for p in range(4)]

    def nearest(p, x):
        squares = ((np.array(books[p], object) - np.array(x, object)) ** 2).sum(1)
        return min((int(d), i) for i, d in enumerate(squares))

    for _ in range(rounds):
        for p in range(4):
            members = {}
            for v in whole:
                members.setdefault(nearest(p, part(v, p))[1], []).append(part(v, p))
            for i, vs in members.items():
                books[p][i] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = [[nearest(p, part(v, p)) for p in range(4)] for v in whole]
    errors = [sum(d for d, _ in f) for f in found]
    labels = {}
    for (_, _, label), e in zip(rows, errors, strict=True):
        labels[label] = labels.get(label, 0) + e
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, labels[label], sha) for (i, _, label), f, e in zip(rows, found, errors, strict=True)), key=str)


def of_table(df):
    return [(r.vec_id, list(r.embedding), r.label) for r in df.collect()]


def got(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=str)


def test_whole_table(spark):
    rows = of_table(spark.read.parquet(f"{SF}/embeddings.parquet"))
    assert got(codes.op12_vector_codes(spark, SF)) == brute(rows)


def write(spark, rows, tmp_path):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def test_nulls_ties_and_repeated_rows(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(int(i) if i % 37 else None, [float(x) for x in rng.integers(-3, 3, 8) / 1024.0 + 0.0003], None if i % 5 == 0 else int(i % 3)) for i in range(700)]
    rows += rows[10:60] + [(7, [0.5] * 8, 1), (7, [-0.5] * 8, 1)]
    odd = [(1, None, 1), (2, [0.0, None] + [0.0] * 6, 1), (3, [float("nan")] + [0.0] * 7, None), (4, [float("-inf")] + [0.0] * 7, 2)]
    out = got(codes.op12_vector_codes(spark, write(spark, rows + odd, tmp_path)))
    as_floats = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert out == brute(as_floats)


def test_other_lengths_few_rows_and_none(spark, tmp_path):
    few = [(1, [0.25, -0.25, 1.0, 2.0], 1), (2, [0.5, 0.5, 0.5, 0.5], None), (3, [1.0] * 8, 1), (4, [], 1)]
    out = {r[0]: r for r in got(codes.op12_vector_codes(spark, write(spark, few, tmp_path / "few")))}
    assert {k: (v[1], v[2]) for k, v in out.items()} == {1: ("00000000", 0), 2: ("01010101", 0), 3: (None, None), 4: (None, None)} and out[1][3] == 0
    assert got(codes.op12_vector_codes(spark, write(spark, [(1, None, 1)], tmp_path / "none"))) == []
    with pytest.raises(ValueError):
        codes.op12_vector_codes(spark, write(spark, [(1, [1.0] * 6, 1)], tmp_path / "six"))
    with pytest.raises(OverflowError):
        codes.op12_vector_codes(spark, write(spark, [(1, [1e30] * 4, 1)], tmp_path / "large"))


@pytest.mark.parametrize("span,width,n", [(2, 2, 256), (5, 4, 256), (1000, 16, 256), (1 << 26, 8, 100), (3, 1, 256), (400, 16, 5)])
def test_trees_find_the_nearest_and_lowest(span, width, n):
    rng = np.random.default_rng(span)
    entries, queries = rng.integers(-span, span, (n, width)), rng.integers(-span, span, (2000, width))
    queries[:n] = entries[: len(queries[:n])]
    index, best = codes.Tree(entries).nearest(queries)
    squares = ((queries[:, None, :] - entries) ** 2).sum(-1)
    assert (best == squares.min(1)).all() and (index == squares.argmin(1)).all()


def test_codes_round_trip_and_clashing_names(spark):
    rng = np.random.default_rng(1)
    vectors = spark.createDataFrame([(i, [float(x) for x in rng.normal(0, 1, 8)], "mine") for i in range(40)], "vec_id long, embedding array<double>, code string")
    books = codes.codebooks(vectors, "embedding", "vec_id")
    for r in codes.encode(vectors, books).collect():
        assert r.code == "mine"
        whole = [math.floor(1024 * x) for x in r.embedding]
        assert sum((a - b) ** 2 for a, b in zip(whole, codes.decode(books, r.code_), strict=True)) == r.error
