import numpy as np
from pyspark.sql import functions as F

from millrace.llm import quality as q


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{base}/labels.parquet")
    got = q.op5_quality(spark, base).join(labels, "doc_id").where("held_out").select("quality", "score", "predicted").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    accuracy = (got.quality == got.predicted).mean()
    print("held-out accuracy", accuracy, good.predicted.mean(), 1 - bad.predicted.mean())
    assert accuracy > 0.95 and good.predicted.mean() > 0.97 and bad.predicted.mean() < 0.15


def slow_score(net, x):
    """One bag, passage by passage, in plain loops."""
    w = net.weights
    h = [[np.tanh(sum(p[i] * w["W"][i, j] for i in range(len(p))) + w["b"][j]) for j in range(q.HIDDEN)] for p in x]
    e = []
    for row in h:
        gate = [np.tanh(sum(row[i] * w["V"][i, j] for i in range(q.HIDDEN))) / (1 + np.exp(-sum(row[i] * w["U"][i, j] for i in range(q.HIDDEN)))) for j in range(q.GATE)]
        e.append(np.exp(sum(g * w["w"][j] for j, g in enumerate(gate))))
    z = [sum(e[p] * h[p][j] for p in range(len(x))) / sum(e) for j in range(q.HIDDEN)]
    return 1 / (1 + np.exp(-(sum(z[j] * w["c"][j] for j in range(q.HIDDEN)) + w["d"])))


def some_bags():
    rng = np.random.default_rng(2)
    bounds = np.array([0, 1, 4, 9, 11])
    net = q.begin(np.zeros(q.FEATURES), np.ones(q.FEATURES))
    net.weights = {k: rng.normal(0, 0.4, v.shape) for k, v in net.weights.items()}
    return net, rng.normal(0, 1, (11, q.FEATURES)), bounds, np.array([0.0, 1, 1, 0])


def test_forward_pass_against_plain_loops():
    net, x, bounds, _ = some_bags()
    assert np.allclose(net.forward(x, bounds)["p"], [slow_score(net, x[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], atol=1e-9)


def test_gradient_against_differences():
    net, x, bounds, label = some_bags()

    def loss():
        p = net.forward(x, bounds)["p"]
        return -(label * np.log(p) + (1 - label) * np.log(1 - p)).mean()

    rng, grad = np.random.default_rng(3), net.gradient(x, bounds, label)
    for k, w in net.weights.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in w.shape)
            kept, step = w[at].copy(), 1e-5
            both = []
            for sign in (1, -1):
                net.weights[k] = w.copy()
                net.weights[k][at] = kept + sign * step
                both.append(loss())
            net.weights[k] = w
            assert abs((both[0] - both[1]) / (2 * step) - grad[k][at]) < 1e-6, k


def test_gradient_learns_from_bags_and_attends():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (600 * 5, q.FEATURES)).astype(np.float32)
    label = rng.integers(0, 2, 600).astype(float)
    x[np.arange(600) * 5 + rng.integers(0, 5, 600), 3] += np.where(label == 1, 8, -8)
    bounds = np.arange(601) * 5
    net = q.train(x, bounds, label)
    assert ((net.score(x, bounds) > 0.5) == (label == 1)).mean() > 0.95


def test_words_of_a_passage_are_its_features():
    texts = [b"one two three two", b"", b"w " * 200, b"One two three two"]
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    x, bounds = q.passages(data, offsets)
    assert bounds.tolist() == [0, 1, 2, 6, 7]
    words, pairs = x[:, q._FORM : q._FORM + q.BUCKETS], x[:, q._FORM + q.BUCKETS :]
    assert np.allclose(words.sum(1), [1, 0, 1, 1, 1, 1, 1]) and np.allclose(pairs[[0, 1, 2, 5]].sum(1), [0.75, 0, 63 / 64, 7 / 8])
    assert (x[2:5] == x[2]).all() and not np.array_equal(words[0], words[6])  # case counts


def test_odd_texts_and_empty_tables(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "word " * 1000), (4, "word " * 1000), (None, "é" * 300), (5, "A fine day. It was good."), (6, "long text. " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("n_passages", F.lit(0))
    labels = spark.createDataFrame([(1, 0), (4, 0), (4, 1), (5, 1), (5, None), (None, 1), (99, 0), (2, 0), (6, 1)], "doc_id long, quality int")
    net = q.fit(docs, labels)
    scored = q.score(docs, net)
    assert scored.columns == [*docs.columns, "score_", "n_passages_"]
    out = scored.collect()
    assert len(out) == 8 and all(0 <= r.score_ <= 1 and r.score == "clash" for r in out)
    assert len({r.score_ for r in out if r.doc_id == 4}) == 1 and {r.n_passages_ for r in out if r.doc_id == 4} == {16}
    assert {r.n_passages_ for r in out if r.doc_id == 6} == {1250}
    constant = q.fit(docs, labels.where("quality = 1"))
    assert {r.score_ for r in q.score(docs, constant).collect()} == {1.0}
    assert {r.score_ for r in q.score(docs, q.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert q.score(docs.limit(0), net).count() == 0
