"""Removing byte strings that an earlier document already has, with a sparse, range-partitioned suffix index.

A byte goes if a ``length``-byte string that covers it also starts in a document with a smaller doc_id. The suffixes that
are indexed are those at *anchors*: every window of ``length`` bytes picks the least-hashed of its ``length // 5 * 2``-byte
substrings, so two equal windows pick equal anchors, and about one position in fifteen is an anchor.

1. Suffixes go to buckets by range of their leading token, which is the anchor's hash: the splitters of a uniform hash are
   known without sampling. (Leading bytes of text are far from uniform: one passage would fill a bucket.) A bucket sorts
   its suffixes by token, then by context (all bytes of windows round the anchor), then by doc_id. Equal contexts with a
   smaller doc_id: every window round that anchor is a repeat. Equal tokens with unequal contexts: undecided.
2. Only round undecided anchors, the windows themselves are bucketed, sorted and compared in the same way.

Each task sorts what it has before sending, and sends one entry per distinct suffix, so a passage that a third of all
documents share reaches its bucket once per block of text, not once per document. Comparing neighbours across bucket
boundaries is not needed, as equal tokens never straddle one. Multikey quicksort on strings is replaced by sorts of 64-bit
keys: in Python a byte-wise quicksort of every suffix took far too long, and the order among unequal suffixes is not used.

Defined cases: null text is empty; rows with equal doc_id do not count as earlier than each other; a null doc_id is neither
changed nor looked at; texts shorter than ``length`` stay as they are, and longer ones are worked on whole; extra columns,
whatever their names, are left out of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import text as tx

#: Anchors that a task gathers before it sorts and sends them.
BLOCK = 1 << 19
#: Bytes of text for each bucket, about.
BUCKET_BYTES = 4 << 20
#: Bytes of text worked on at once, about; some fifteen arrays of eight bytes each go with one byte.
CHUNK = 1 << 19
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW48 = np.uint64((1 << 48) - 1)
_PACKED = "bucket long, kind int, docs binary, counts binary, low binary, rest binary"


def _slide(f, x: np.ndarray, width: int) -> np.ndarray:
    """f over x[i : i + width], for each i (fewer at the end)."""
    x, span = x.copy(), 1
    while span * 2 <= width:
        x[:-span] = f(x[:-span], x[span:])
        span *= 2
    if rest := width - span:
        y = x.copy()
        y[:-rest] = f(y[:-rest], x[rest:])
        return y
    return x


class Anchors:
    """Anchors of a chunk of rows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int) -> None:
        self.length, self.token = length, max(1, length // 5 * 2)
        self.span = width = length - self.token + 1
        n, token = len(data), self.token
        self.sums, self.starts, self.ends = tx.prefix(data), offsets[:-1], offsets[1:] - 1
        row = np.repeat(np.arange(len(self.starts)), np.diff(offsets))
        room = self.ends[row] - np.arange(n)  # bytes of the row from here on
        h = np.full(n, _NONE)
        if n > token:
            _, down = tx.powers(n)
            h[: n - token] = tx.mix((self.sums[token:n] - self.sums[: n - token]) * down[: n - token]) & ~np.uint64(1)
            h[room < token] = _NONE
        least = _slide(np.minimum, h, width) if n > width else h.copy()
        self.valid = room >= length
        self.least = least
        top = np.where(self.valid, least, np.uint64(0))
        if n > width:
            top = _slide(np.maximum, top[::-1], width)[::-1]
        self.at = np.flatnonzero((h == top) & (h != _NONE))
        self.hash, self.row = h[self.at], row[self.at]
        self.first = np.maximum(self.at - width + 1, self.starts[self.row])  # windows round the anchor start in
        self.last = np.minimum(self.at, self.ends[self.row] - length)  # first..last
        high = np.minimum(self.at + length, self.ends[self.row])
        self.context = tx.stretch_hashes(self.sums, self.first, high) ^ tx.mix((self.at - self.first).astype(np.uint64))

    def classes(self, bits: int) -> np.ndarray:
        return _class(self.hash >> np.uint64(32 - bits), self.context & _LOW48)

    def windows(self, which: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Starts of the windows that picked these anchors; without those that lie round the known anchors."""
        at = self.at[which, None] - np.arange(self.span)
        good = (at >= self.first[which, None]) & (at <= self.last[which, None])
        good &= self.least[np.maximum(at, 0)] == self.hash[which, None]
        at = np.unique(at[good])
        return at[self._round(known)[at] == 0]

    def _round(self, known: np.ndarray) -> np.ndarray:
        turn = np.zeros(len(self.sums) + 1, np.int32)
        np.add.at(turn, self.first[known], 1)
        np.add.at(turn, self.last[known] + 1, -1)
        return np.cumsum(turn)

    def window_hashes(self, at: np.ndarray) -> np.ndarray:
        return tx.stretch_hashes(self.sums, at, at + self.length)


def _class(leading: np.ndarray, context: np.ndarray) -> np.ndarray:
    return tx.mix(leading * _M1 + context)


def _flags(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _pack(bucket: np.ndarray, kind: int, doc: np.ndarray, low: np.ndarray | None, rest: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """One row for each bucket: doc_ids as differences, entries of each, and the entries' columns."""
    order = np.lexsort((doc, bucket))
    bucket, doc, rest = bucket[order], doc[order], rest[order]
    low = None if low is None else low[order]
    edges = np.append(np.flatnonzero(_flags(bucket)), len(bucket))
    rows: list[tuple] = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        starts = np.flatnonzero(_flags(doc[a:b]))
        ids = doc[a:b][starts]
        rows.append((
            int(bucket[a]), kind, np.diff(ids, prepend=0).tobytes(), np.diff(np.append(starts, b - a)).astype(np.int32).tobytes(),
            b"" if low is None else low[a:b].astype(np.uint32).tobytes(), np.ascontiguousarray(rest[a:b].view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()))
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "kind", "docs", "counts", "low", "rest"])


def _unpack(table: pa.Table, kind: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    docs, lows, rests = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], [np.zeros((0, 8), np.uint8)]
    for r in table.select(["kind", "docs", "counts", "low", "rest"]).to_pylist():
        if r["kind"] == kind:
            docs.append(np.repeat(np.cumsum(np.frombuffer(r["docs"], np.int64)), np.frombuffer(r["counts"], np.int32)))
            lows.append(np.frombuffer(r["low"], np.uint32))
            part = np.frombuffer(r["rest"], np.uint8).reshape(-1, width)
            rests.append(np.concatenate((part, np.zeros((len(part), 8 - width), np.uint8)), 1))
    return np.concatenate(docs), np.concatenate(lows), np.ascontiguousarray(np.concatenate(rests)).view(np.uint64).reshape(-1)


def _replies(parts: list[tuple[np.ndarray, np.ndarray]], names: list[str]) -> pa.Table:
    """One row for each doc, with the values of each part as bytes, or null."""
    ids = np.unique(np.concatenate([d for d, _ in parts]))
    columns = [pa.array(ids, pa.int64())]
    for doc, value in parts:
        order = np.argsort(doc, kind="stable")
        counts = np.bincount(np.searchsorted(ids, doc), minlength=len(ids)) if len(ids) else np.zeros(0, np.int64)
        ends = np.concatenate(([0], np.cumsum(counts) * 8)).astype(np.int32)
        blank = pa.py_buffer(np.packbits(counts > 0, bitorder="little").tobytes())
        columns.append(pa.Array.from_buffers(pa.binary(), len(ids), [blank, pa.py_buffer(ends.tobytes()), pa.py_buffer(value[order].tobytes())]))
    return pa.Table.from_arrays(columns, names=["doc", *names])


def _first_docs(doc: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the keys, then doc; where each run of equal keys starts; the least doc of each entry's run, in that order."""
    order = np.lexsort((doc, *reversed(keys)))
    starts = np.flatnonzero(_flags(*(k[order] for k in keys)))
    least = np.repeat(doc[order][starts], np.diff(np.append(starts, len(order))))
    return order, starts, least


def _send_suffixes(bits: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            h, context, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            leading = h >> np.uint64(32 - bits)
            name = _class(leading, context)
            order, starts, least = _first_docs(doc, name)
            yield from _pack((h >> np.uint64(64 - bits)).astype(np.int64)[order][starts], 0, doc[order][starts], (leading & np.uint64(0xFFFFFFFF))[order][starts], context[order][starts], 6)
            known = doc[order] > least
            if known.any():  # settled here; spread over the buckets, as these rows only pass through
                yield from _pack((doc[order][known] >> 4) % (1 << bits), 1, doc[order][known], None, name[order][known], 8)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, _, data, offsets in tx.chunks(batch.column(1), CHUNK):
                a = Anchors(data, offsets, length)
                held.append((a.hash, a.context & _LOW48, ids[first + a.row].astype(np.int64)))
                if sum(len(x[0]) for x in held) >= BLOCK:
                    yield from flush()
        if held:
            yield from flush()

    return run


def _settle_suffixes(bits: int):
    def run(table: pa.Table) -> pa.Table:
        doc, low, context = _unpack(table, 0, 6)
        bucket = table.column("bucket")[0].as_py()
        order, starts, least = _first_docs(doc, low, context)
        doc, low, context = doc[order], low[order], context[order]
        name = _class((np.uint64(bucket) << np.uint64(32)) + low.astype(np.uint64), context)
        repeat = doc > least
        tokens = np.flatnonzero(_flags(low))
        if len(tokens):
            kinds = np.diff(np.searchsorted(starts, np.append(tokens, len(low))))
            shared = (np.minimum.reduceat(doc, tokens) != np.maximum.reduceat(doc, tokens)) & (kinds > 1)
            undecided = np.repeat(shared, np.diff(np.append(tokens, len(low)))) & ~repeat
        else:
            undecided = np.zeros(len(doc), bool)
        before, _, known = _unpack(table, 1, 8)
        return _replies([(np.concatenate((doc[repeat], before)), np.concatenate((name[repeat], known))), (doc[undecided], name[undecided])], ["same", "open"])

    return run


def _told(column: pa.Array, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (within the chunk) and values of lists of packed 64-bit values."""
    values = [b"".join(x) if x else b"" for x in column.slice(first, end - first).to_pylist()]
    return np.repeat(np.arange(end - first), [len(x) // 8 for x in values]), np.frombuffer(b"".join(values), np.uint64)


def _among(row: np.ndarray, value: np.ndarray, told: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.isin(tx.mix(value + row.astype(np.uint64) * _M2), tx.mix(told[1] + told[0].astype(np.uint64) * _M2))


def _send_windows(bits: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            h, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order, starts, least = _first_docs(doc, h)
            h, doc = h[order], doc[order]
            yield from _pack((h[starts] >> np.uint64(64 - bits)).astype(np.int64), 0, doc[starts], None, h[starts], 8)
            known = doc > least
            if known.any():
                yield from _pack((doc[known] >> 4) % (1 << bits), 1, doc[known], None, h[known], 8)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, end, data, offsets in tx.chunks(batch.column(1), CHUNK):
                a = Anchors(data, offsets, length)
                name = a.classes(bits)
                at = a.windows(np.flatnonzero(_among(a.row, name, _told(batch.column(3), first, end))), _among(a.row, name, _told(batch.column(2), first, end)))
                row = np.searchsorted(a.starts, at, "right") - 1
                held.append((a.window_hashes(at), ids[first + row].astype(np.int64)))
                if sum(len(x[0]) for x in held) >= BLOCK:
                    yield from flush()
        if held:
            yield from flush()

    return run


def _settle_windows(table: pa.Table) -> pa.Table:
    doc, _, h = _unpack(table, 0, 8)
    order, _, least = _first_docs(doc, h)
    doc, h = doc[order], h[order]
    before, _, known = _unpack(table, 1, 8)
    return _replies([(np.concatenate((doc[doc > least], before)), np.concatenate((h[doc > least], known)))], ["windows"])


def _take_out(bits: int, length: int, with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, digests, kept = [], [], [], [], []
            for first, end, data, offsets in tx.chunks(batch.column(1), CHUNK):
                turn = np.zeros(len(data) + 1, np.int32)
                same, windows = _told(batch.column(2), first, end), _told(batch.column(4), first, end)
                if len(same[1]) or len(windows[1]):
                    a = Anchors(data, offsets, length)
                    name = a.classes(bits)
                    known = _among(a.row, name, same)
                    np.add.at(turn, a.first[known], 1)
                    np.add.at(turn, a.last[known] + length, -1)
                    at = a.windows(np.flatnonzero(_among(a.row, name, _told(batch.column(3), first, end))), known)
                    at = at[_among(np.searchsorted(a.starts, at, "right") - 1, a.window_hashes(at), windows)]
                    np.add.at(turn, at, 1)
                    np.add.at(turn, at + length, -1)
                gone = np.cumsum(turn[:-1]) > 0
                for s, e in zip(offsets[:-1].tolist(), (offsets[1:] - 1).tolist(), strict=True):
                    cut = gone[s:e]
                    left = data[s:e][~cut].tobytes()
                    n_bytes.append(e - s)
                    n_removed.append(e - s - len(left))
                    n_spans.append(int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum()))
                    digests.append(hashlib.sha256(left).hexdigest())
                    if with_bytes:
                        kept.append(left)
            more = [pa.array(kept, pa.binary())] if with_bytes else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string()), *more],
                names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_bytes])

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text_col: str = "text", length: int = 50, with_bytes: bool = True) -> DataFrame:
    """One row for each row of ``docs``: key, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (bytes)."""
    if length < 5:
        raise ValueError("length is at least 5")
    total = docs.select(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = min(31, max(3, int(total // BUCKET_BYTES).bit_length()))  # 32 bits of a token are kept besides the bucket
    base = docs.select(F.col(key).cast("long").alias("doc"), F.col(text_col).alias("body"))  # new names: an alias that changes nothing would be dropped on one side only, and the shuffle below not shared
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total // (64 << 20)))
    # one shuffle of the texts serves both joins below, as both see the same filtered rows
    placed = base.where("doc is not null").repartition(parts, "doc")
    some = lambda c: F.collect_list(c).alias(c)

    sent = base.where("doc is not null and body is not null").mapInArrow(_send_suffixes(bits, length), _PACKED)
    first = sent.groupBy("bucket").applyInArrow(_settle_suffixes(bits), "doc long, same binary, open binary").groupBy("doc").agg(some("same"), some("open"))
    sent = placed.join(first.where(F.size("open") > 0), "doc").select("doc", "body", "same", "open").mapInArrow(_send_windows(bits, length), _PACKED)
    second = sent.groupBy("bucket").applyInArrow(_settle_windows, "doc long, windows binary").groupBy("doc").agg(some("windows"))
    every = placed.join(first, "doc", "left").join(second, "doc", "left").select("doc", "body", "same", "open", "windows")
    untold = [F.lit(None).cast("array<binary>").alias(c) for c in ("same", "open", "windows")]
    every = every.union(base.where("doc is null").select("doc", "body", *untold))
    out = every.mapInArrow(_take_out(bits, length, with_bytes), "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes)
    return out.withColumnRenamed("doc", key)


def op10_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), with_bytes=False)


QUERIES = {"op10_repeats": op10_repeats}
