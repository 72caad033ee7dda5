import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import media


def test_round_trip_and_digests(spark):
    rows = [(1, None), (2, ""), (3, "a" * 64), (4, "é" * 40), (5, "The quick brown fox. " * 3000), (5, "The quick brown fox. " * 3000), (6, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("xx")).withColumn("media_", F.lit(0)).repartition(3)
    out = media.media_columns(frame).collect()
    assert len(out) == len(rows)
    for r in out:
        raw = (r.text or "").encode()
        want = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        with wave.open(io.BytesIO(bytes(r.media))) as f:
            assert (f.getsampwidth(), f.getnchannels(), f.readframes(f.getnframes())) == (1, 1, want)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(want), zlib.crc32(want[-64:]))
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.lang == "xx"
        t, c = media.fingerprint(want)
        assert [(x.time, x.code) for x in r.fingerprint] == list(zip(t.tolist(), c.tolist(), strict=True))
    same = [r for r in out if r.doc_id == 5]
    assert same[0][2:] == same[1][2:] and len(same[0].fingerprint) > 100
    assert media.media_columns(frame.limit(0)).count() == 0


def test_a_tone_peaks_at_its_frequency():
    n = np.arange(20_000)
    samples = (128 + 100 * np.sin(2 * np.pi * 50 / media.FRAME * n)).astype(np.uint8).tobytes()
    t, f = media.peaks(samples)
    assert (np.abs(f - 50) <= 1).sum() >= 8 and (np.diff(t) >= 0).all()
    assert media.fingerprint(bytes([128]) * 5000)[0].size == 0


def test_runs_of_frames_give_what_one_run_gives(monkeypatch):
    samples = np.random.default_rng(1).integers(0, 256, 60_000).astype(np.uint8).tobytes()
    want = media.fingerprint(samples)
    monkeypatch.setattr(media, "AT_ONCE", media.SLOT)
    assert all(np.array_equal(a, b) for a, b in zip(media.fingerprint(samples), want, strict=True))


def test_spectrum_peaks_and_pairs_against_plain_loops():
    samples = np.random.default_rng(6).integers(0, 256, 6000).astype(np.uint8).tobytes()
    x = [b - 128 for b in samples]
    frames = -(-(len(x) - media.FRAME) // media.HOP) + 1
    angle = -2j * np.pi * np.outer(np.arange(media.FRAME // 2 + 1), np.arange(media.FRAME)) / media.FRAME
    bell = [0.5 - 0.5 * np.cos(2 * np.pi * i / (media.FRAME - 1)) for i in range(media.FRAME)]
    mag = []
    for f in range(frames):
        part = x[f * media.HOP : f * media.HOP + media.FRAME]
        part += [0] * (media.FRAME - len(part))
        mag.append(np.abs(np.exp(angle) @ np.array([a * b for a, b in zip(part, bell, strict=True)])))
    got = np.concatenate(list(media.spectrogram(samples)))
    assert np.allclose(got, mag, rtol=1e-3, atol=0.05)
    peaks = []
    for a in range(0, frames, media.SLOT):
        for low, high in zip(media.BANDS[:-1], media.BANDS[1:], strict=True):
            peaks.append(max(((f, k) for f in range(a, min(a + media.SLOT, frames)) for k in range(low, high)), key=lambda p: mag[p[0]][p[1]]))
    peaks.sort()
    assert peaks == list(zip(*(v.tolist() for v in media.peaks(samples)), strict=True))
    pairs = sorted((t, f << 41 | g << 32 | u - t) for i, (t, f) in enumerate(peaks) for u, g in peaks[i + 1 : i + 1 + media.FAN])
    assert pairs == list(zip(*(v.tolist() for v in media.fingerprint(samples)), strict=True))


def test_query_derives_its_digests_from_the_operator(spark):
    docs = {r.doc_id: r for r in media.media_columns(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")).collect()}
    for r in media.op8_media(spark, "/root/testdata/sf0.001").collect():
        d = docs[r.doc_id]
        assert (r.media_bytes, r.media_sha256, r.payload_sha256) == (len(d.media), hashlib.sha256(bytes(d.media)).hexdigest(), d.payload_sha256)
        assert r.feature.startswith(f"peak-pairs:{len(d.fingerprint)}:")


def test_query_covers_its_table(spark):
    out = media.op8_media(spark, "/root/testdata/sf0.001")
    assert out.count() == 200 and out.where("feature is null").count() == 0
