import hashlib
import random

from pyspark.sql import functions as F

from millrace.llm import repeats as rp


def brute(rows, length):
    """rows with distinct, non-null ids."""
    rows = sorted((i, (t or "").encode()) for i, t in rows)
    seen, out = set(), {}
    for i, raw in rows:
        cut = bytearray(len(raw))
        windows = [raw[k : k + length] for k in range(len(raw) - length + 1)]
        for k, w in enumerate(windows):
            if w in seen:
                cut[k : k + length] = b"\1" * length
        seen.update(windows)
        kept = bytes(b for b, c in zip(raw, cut, strict=True) if not c)
        spans = sum(c and not p for c, p in zip(cut, b"\0" + cut[:-1], strict=False))
        out[i] = (len(raw), sum(cut), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out


def result(frame):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in frame.collect()}


def test_against_brute_force_on_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()], 50)
    assert result(rp.remove_repeats(docs)) == want
    assert sum(v[1] > 0 for v in want.values()) > 100


def test_edits_ties_periodic_and_short_texts(spark, monkeypatch):
    monkeypatch.setattr(rp, "BLOCK", 500)
    monkeypatch.setattr(rp, "BUCKET_BYTES", 2000)
    rng = random.Random(3)
    text = "".join(rng.choice("abcdé ") for _ in range(300))
    rows = [(i, text[: rng.randrange(300)] + rng.choice(["", "x", "zz"]) + text[rng.randrange(300) :]) for i in range(60)]
    rows += [(100, "ab" * 200), (101, "ab" * 30), (102, "a" * 500), (103, "a" * 50), (104, "a" * 49), (105, None), (106, ""), (107, text), (-5, text[10:200]), (108, "\n" * 120), (109, "\n" * 60 + text[5:90])]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit("clash")).repartition(5)
    for length in (50, 9, 5, 12):
        assert result(rp.remove_repeats(frame, length=length)) == brute(rows, length), length


def test_repeated_rows_null_ids_and_empty_tables(spark):
    t = "lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod"
    frame = spark.createDataFrame([(1, t), (1, t), (None, t), (2, t)], "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_removed) for r in rp.remove_repeats(frame).collect()), key=str) == [(1, 0), (1, 0), (2, len(t)), (None, 0)]
    assert rp.remove_repeats(frame.limit(0)).count() == 0
