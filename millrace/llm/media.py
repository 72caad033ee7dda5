"""Media columns: payloads stored as WAV, read back, and fingerprinted by pairs of spectral peaks.

A payload is the text's UTF-8 bytes, zero-padded to a positive multiple of 64; it becomes the samples of a mono 8-bit WAV
file. What is read back goes through a short-time Fourier transform; in each stretch of time and band of frequency the
strongest bin is a peak, and each peak is paired with the next few peaks that follow it. A fingerprint is the code
``frequency << 41 | frequency of the partner << 32 | steps between them`` with the step at which it starts.

Defined cases: null text is empty (64 zero bytes); silence has no peaks and an empty fingerprint; the features depend on the
text alone, so equal texts have equal values whatever rows surround them; a long text is transformed in runs of frames, which
bounds what it takes; extra columns pass through, and new ones whose names are taken get a trailing underscore.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm import text as tx

UNIT = 64
RATE = 8000
FRAME, HOP = 512, 256
#: Bands of frequency bins, each of which may have one peak in a slot of SLOT frames.
BANDS = (2, 16, 32, 64, 128, 257)
SLOT = 8
#: Partners of a peak.
FAN = 3
#: Frames transformed at once, which bounds the memory that a long payload takes.
AT_ONCE = 2048
_WINDOW = np.hanning(FRAME).astype(np.float32)


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def write_wav(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(rate)
        f.writeframes(samples)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        if (f.getnchannels(), f.getsampwidth()) != (1, 1):
            raise ValueError("only mono 8-bit samples are read")
        return f.readframes(f.getnframes())


def spectrogram(samples: bytes) -> Iterator[np.ndarray]:
    """Magnitudes of all frames, in runs of AT_ONCE frames; the last frame is filled up with silence."""
    x = np.frombuffer(samples, np.uint8)
    frames = max(1, -(-max(0, len(x) - FRAME) // HOP) + 1)
    for first in range(0, frames, AT_ONCE):
        n = min(AT_ONCE, frames - first)
        part = x[first * HOP : (first + n - 1) * HOP + FRAME].astype(np.float32) - 128
        part = np.pad(part, (0, (n - 1) * HOP + FRAME - len(part)))
        yield np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP] * _WINDOW, axis=1))


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times (frames) and frequency bins of the peaks, in order of time, then frequency. AT_ONCE is a multiple of SLOT."""
    times, bins, start = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for mag in spectrogram(samples):
        n = len(mag)
        slots = -(-n // SLOT)
        for low, high in zip(BANDS[:-1], BANDS[1:], strict=True):
            part = np.zeros((slots * SLOT, high - low), np.float32)
            part[:n] = mag[:, low:high]
            flat = part.reshape(slots, -1)
            best = flat.argmax(1)
            loud = flat[np.arange(slots), best] > 1e-3
            times.append((start + np.arange(slots) * SLOT + best // (high - low))[loud])
            bins.append((low + best % (high - low))[loud])
        start += n
    t, f = np.concatenate(times), np.concatenate(bins)
    order = np.lexsort((f, t))
    return t[order], f[order]


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times and codes of peak pairs."""
    t, f = peaks(samples)
    times, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(1, FAN + 1):
        if len(t) > k:
            times.append(t[:-k])
            codes.append(f[:-k] << 41 | f[k:] << 32 | t[k:] - t[:-k])
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order], c[order]


def media_columns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_bytes, media (the file), payload_bytes, payload_sha256 and tail_crc32 of what is read back from it, and
    fingerprint (array of (time, code))."""
    where = docs.columns.index(text_col)
    schema = tx.extended(docs, "n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, fingerprint array<struct<time: long, code: long>>")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                n, media, payload, digest, tail, times, codes = [], [], [], [], [], [], []
                for x in part.column(where):
                    size, raw = payload_of(x.as_py())
                    media.append(write_wav(raw))
                    back = read_wav(media[-1])
                    t, c = fingerprint(back)
                    n.append(size), payload.append(len(back)), digest.append(hashlib.sha256(back).hexdigest()), tail.append(zlib.crc32(back[-UNIT:]))
                    times.append(t), codes.append(c)
                ends = np.concatenate(([0], np.cumsum([len(t) for t in times])))
                pairs = pa.StructArray.from_arrays([tx.int64s(np.concatenate(times)), tx.int64s(np.concatenate(codes))], names=["time", "code"])
                prints = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
                yield pa.RecordBatch.from_arrays([*part.columns, tx.int64s(n), pa.array(media, pa.binary()), tx.int64s(payload), pa.array(digest), tx.int64s(tail), prints], names=names)

    return docs.mapInArrow(run, schema)


def op8_media(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = media_columns(docs)
    feature = F.concat_ws(":", F.lit("peak-pairs"), F.size("fingerprint").cast("string"), F.hex(F.xxhash64("fingerprint")))
    return out.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))


QUERIES = {"op8_media": op8_media}
