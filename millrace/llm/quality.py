"""Quality scores by gated-attention multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is described by its words (shares of hashed words and word
pairs, ``BUCKETS`` of each) and by its form (shares of character classes, word lengths, repetition), and encoded by one layer;
a gated attention gives every passage its weight; the weighted sum of encodings is scored by a logistic unit. Only documents
carry labels; the attention finds the passages that speak for them. The net is trained with a bounded sample of labelled
documents (``SAMPLE``, the least by a hash of doc_id), each with all its passages; every text is scored whole.

The sample's bags are moved to the driver as features (some hundred bytes a passage), so what it holds is bounded by the
sample and the length of its texts; a batch of training is drawn from them by documents.

Defined cases: a null, empty or wordless text is one passage without words; a document with several labels has their mean,
1 from a half up; null labels and labels without a document are ignored; rows with equal doc_id and different texts are
learned from each, with the label of the id; with labels of fewer than two kinds every score is the labels' mean (0.5 without
any); repeated rows score alike; extra columns pass through, and where the input has a column of the name of a new one, the
new one gets a trailing underscore.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import text as tx

PASSAGE = 64
SAMPLE = 6000
HIDDEN, GATE = 16, 8
STEPS, BATCH, RATE = 500, 128, 0.02
THRESHOLD = 0.7
#: Buckets of hashed words, and as many of hashed word pairs.
BUCKETS = 64

# classes of bytes: lower, upper, digit, white, sentence marks, other common marks, other ASCII, beyond ASCII
_CLASS = np.full(256, 6, np.uint8)
_CLASS[0x80:] = 7
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = 0, 1, 2
_CLASS[[0x20, *range(0x09, 0x0E)]] = 3
_CLASS[[ord(c) for c in ".,;:?'\""]] = 4
_CLASS[[ord(c) for c in "!|#$%&*"]] = 5
_CLASSES = 8
_FORM = _CLASSES + 8
FEATURES = _FORM + 2 * BUCKETS


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the rows, in order, and the first passage of each row (and the end)."""
    starts, ends, h = tx.word_hashes(data, tx.DARK)
    first = np.searchsorted(starts, offsets)
    n_words = np.diff(first)
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    bounds = np.concatenate(([0], np.cumsum(n_passages)))
    row = np.repeat(np.arange(len(n_words)), n_passages)
    nth = np.arange(len(row)) - bounds[row]
    word_a = np.minimum(first[row] + nth * PASSAGE, first[row + 1])
    word_b = np.minimum(word_a + PASSAGE, first[row + 1])
    words = word_b - word_a
    at = np.append(starts, len(data))
    byte_a = np.where(nth == 0, offsets[row], at[word_a])
    byte_b = np.append(byte_a[1:], len(data))
    kind = _CLASS[data]
    counts = np.empty((len(row), _CLASSES), np.float32)
    for c in range(_CLASSES):
        sums = np.concatenate(([0], np.cumsum(kind == c, dtype=np.int64)))
        counts[:, c] = sums[byte_b] - sums[byte_a]
    out = np.zeros((len(row), FEATURES), np.float32)
    out[:, :_CLASSES] = counts / np.maximum(byte_b - byte_a, 1)[:, None]
    if len(starts):
        of_word = np.repeat(np.arange(len(row)), words)
        length = np.append(np.cumsum(np.concatenate(([0], ends - starts))), 0)
        total = np.maximum(words, 1)
        out[:, 8] = (length[word_b] - length[word_a]) / total / 10
        order = np.lexsort((h, of_word))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
        out[:, 9] = np.bincount(of_word[order][new], minlength=len(row)) / total
        twice = np.zeros(len(h), bool)
        together = of_word[1:] == of_word[:-1]
        twice[1:] = (h[1:] == h[:-1]) & together
        out[:, 10] = np.bincount(of_word[twice], minlength=len(row)) / total
        of_row = np.repeat(np.arange(len(n_words)), n_words)
        order = np.lexsort((h, of_row))
        new[1:] = (h[order][1:] != h[order][:-1]) | (of_row[order][1:] != of_row[order][:-1])
        out[:, 11] = (np.bincount(of_row[order][new], minlength=len(n_words)) / np.maximum(n_words, 1))[row]
        tail = data[ends - 1]
        out[:, 12] = np.bincount(of_word, weights=np.isin(tail, np.frombuffer(b".!?", np.uint8)), minlength=len(row)) / total
        out[:, 13] = np.bincount(of_word, weights=_CLASS[tail] == 5, minlength=len(row)) / total
        out[:, 14] = np.bincount(of_word, weights=(ends - starts) == 1, minlength=len(row)) / total
        # what the words are: a histogram of their hashes, and one of the hashes of neighbours
        cell = of_word * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64)
        out[:, _FORM : _FORM + BUCKETS] = np.bincount(cell, minlength=len(row) * BUCKETS).reshape(-1, BUCKETS) / total[:, None]
        pair = tx.mix(h[:-1] * np.uint64(3) + h[1:])[together]
        cell = of_word[1:][together] * BUCKETS + (pair % np.uint64(BUCKETS)).astype(np.int64)
        out[:, _FORM + BUCKETS :] = np.bincount(cell, minlength=len(row) * BUCKETS).reshape(-1, BUCKETS) / total[:, None]
    out[:, 15] = np.log1p(n_words)[row] / 10
    return out, bounds


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Net:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def forward(self, x: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
        w, first = self.weights, bounds[:-1]
        seg = np.repeat(np.arange(len(first)), np.diff(bounds))
        h = np.tanh(x @ w["W"] + w["b"])
        a1, a2 = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        e = (a1 * a2) @ w["w"]
        e = np.exp(e - np.maximum.reduceat(e, first)[seg])
        a = e / np.add.reduceat(e, first)[seg]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return {"seg": seg, "h": h, "a1": a1, "a2": a2, "a": a, "z": z, "p": _sigmoid(z @ w["c"] + w["d"])}

    def gradient(self, x: np.ndarray, bounds: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of the bags, by weight."""
        w, f = self.weights, self.forward(x, bounds)
        seg, h, a = f["seg"], f["h"], f["a"]
        dl = (f["p"] - label) / len(label)
        dz = (dl[:, None] * w["c"])[seg]
        da = (h * dz).sum(1)
        de = a * (da - np.add.reduceat(a * da, bounds[:-1])[seg])
        dg = de[:, None] * w["w"]
        p1, p2 = dg * f["a2"] * (1 - f["a1"] ** 2), dg * f["a1"] * f["a2"] * (1 - f["a2"])
        dh = (a[:, None] * dz + p1 @ w["V"].T + p2 @ w["U"].T) * (1 - h**2)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ p1, "U": h.T @ p2, "w": (f["a1"] * f["a2"]).T @ de, "c": f["z"].T @ dl, "d": dl.sum()}

    def score(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bounds) - 1, self.constant)
        return self.forward((features - self.mean) / self.scale, bounds)["p"]


def begin(mean: np.ndarray, scale: np.ndarray, seed: int = 11) -> Net:
    rng = np.random.default_rng(seed)
    shape = {"W": (FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": ()}
    size = {"W": 1 / np.sqrt(FEATURES)}
    return Net(mean, scale, {k: rng.normal(0, size.get(k, 0.3), s).astype(np.float32) if k not in "bd" else np.zeros(s, np.float32) for k, s in shape.items()})


def train(features: np.ndarray, bounds: np.ndarray, label: np.ndarray) -> Net:
    if len(label) == 0 or label.min() == label.max():
        return Net(np.zeros(FEATURES), np.ones(FEATURES), {}, float(label.mean()) if len(label) else 0.5)
    rng = np.random.default_rng(11)
    mean, scale = features.mean(0), features.std(0) + 1e-3
    net = begin(mean, scale)
    m, v = ({k: np.zeros_like(w) for k, w in net.weights.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        pick = rng.integers(0, len(label), min(BATCH, 4 * len(label)))
        rows = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in pick])
        part = np.concatenate(([0], np.cumsum(bounds[pick + 1] - bounds[pick])))
        rate = RATE * (1 - step / (STEPS + 1))
        for k, g in net.gradient((features[rows] - mean) / scale, part, label[pick]).items():
            w = net.weights[k]
            g = g + 1e-4 * w
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g**2
            net.weights[k] = (w - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", key: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Net:
    """labels: (key, label 0 or 1) of the documents to learn from."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64(key), key).limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in tx.chunks(batch.column(1)):
                x, bounds = passages(data, offsets)
                bags = [x[a:b].astype("<f2").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.slice(first, end - first) for c in (batch.column(0), batch.column(2))), pa.array(bags, pa.binary())], names=["doc", "label", "bag"])

    texts = docs.select(F.col(key).alias("doc"), text_col).join(F.broadcast(chosen.select(F.col(key).alias("doc"), "label")), "doc")  # at most ``sample`` rows
    rows = texts.select("doc", text_col, "label").mapInArrow(run, f"doc {docs.schema[key].dataType.simpleString()}, label int, bag binary").distinct().orderBy("doc", "bag").collect()
    bags = [np.frombuffer(r.bag, "<f2").reshape(-1, FEATURES) for r in rows]
    bounds = np.concatenate(([0], np.cumsum([len(b) for b in bags]))).astype(np.int64)
    return train(np.concatenate(bags).astype(np.float32) if bags else np.zeros((0, FEATURES), np.float32), bounds, np.array([r.label for r in rows], np.float32))


def score(docs: DataFrame, net: Net, text_col: str = "text") -> DataFrame:
    """``docs`` with score and n_passages."""
    model = docs.sparkSession.sparkContext.broadcast(net)
    schema = tx.extended(docs, "score double, n_passages long")
    names, where = schema.names, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = [], []
            for _, _, data, offsets in tx.chunks(batch.column(where), tx.CHUNK // 2):
                x, bounds = passages(data, offsets)
                found += model.value.score(x, bounds).tolist()
                n += np.diff(bounds).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64()), tx.int64s(n)], names=names)

    return docs.mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = score(docs, fit(docs, labels.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages")


QUERIES = {"op5_quality": op5_quality}
