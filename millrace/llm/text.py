"""Vectorised text primitives on Arrow string columns: byte buffers, word boundaries and 64-bit hashes.

Everything here works on a chunk of rows at a time; a chunk holds about ``CHUNK`` bytes, or one row if that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words under the class [^\x20\x09-\x0D].
DARK = ~SPACE
#: Bytes of words under the class [^\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE = _rng.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i up to n."""
    if not _powers or len(_powers[0]) <= n:
        size = 1 << max(16, int(n).bit_length())
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, x)))) for x in (BASE, inverse)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64; a new array."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; nulls count as empty, each row is closed by a newline byte.

    Row i of the run has bytes[offsets[i] : offsets[i + 1] - 1].
    """
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, pa.scalar(b"", pa.large_binary()))
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(at) - 1:
        end = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        offsets = at[first : end + 1] - at[first] + np.arange(end - first + 1)
        out = np.full(int(offsets[-1]), 10, np.uint8)
        keep = np.ones(len(out), bool)
        keep[offsets[1:] - 1] = False
        out[keep] = data[at[first] : at[end]]
        yield first, end, out, offsets
        first = end


def words(data: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes of a class; data ends with a byte outside it."""
    inside = kind[data]
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        turns = np.concatenate(([0], turns))
    return turns[0::2], turns[1::2]


def prefix(data: np.ndarray) -> np.ndarray:
    """Running sums from which hashes of any stretch follow."""
    up, _ = powers(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(BYTE[data] * up[: len(data)], out=sums[1:])
    return sums


def stretch_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches [start, end): equal bytes, equal hashes."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words."""
    starts, ends = words(data, kind)
    return starts, ends, stretch_hashes(prefix(data), starts, ends)


def int64s(values) -> pa.Array:
    return pa.array(values, pa.int64())


def extended(docs, ddl: str):
    """The schema of ``docs`` with further columns; one whose name ``docs`` has already gets trailing underscores."""
    from pyspark.sql.types import StructField, StructType

    taken, more = {c.lower() for c in docs.columns}, []
    for f in StructType.fromDDL(ddl):
        name = f.name
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        more.append(StructField(name, f.dataType, f.nullable))
    return StructType([*docs.schema.fields, *more])
