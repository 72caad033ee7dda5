"""MinHash near-duplicate groups of documents.

A document's set is its distinct word k-shingles (with fewer words, the whole sequence as one). Documents are linked where
``100 * |A & B| >= percent * |A | B|``; a group is a connected component of links, named after its smallest doc_id.

* Equal sets collapse to one class first, so copies cost one row.
* Sketches: one permutation whose range is cut into ``BANDS * ROWS`` bins, empty bins filled by optimal densification
  (each empty bin tries bins in an order of its own until it meets a full one). Sets of any size are sketched in this way.
* Bands are hashed to buckets; in each bucket every class is paired with the least class only (a star).
* Pairs are confirmed on whole sets rebuilt from the texts. Where a bucket still holds classes of different components
  after that, the pairs across components are confirmed too, so no link is lost that the buckets can show; how each class
  differs from the least class of the bucket rules out nearly all others beforehand (an upper bound, so no link is lost to
  it). That test runs inside the join, so its cost, though not its output, is quadratic in the classes of one star that
  are left in several components.

Two sets at the limit share no bucket with a probability of 2e-8 (similarity 0.85; 3e-6 at 0.8) if all bins are
independent; densified bins of small sets are not, but no miss was seen in 1,500 pairs of any size from 12 shingles on.

Defined cases: doc_id is a whole number; a null, empty or wordless text has an empty set, is linked with nothing and is kept;
rows with equal doc_id are one document as far as groups go, which has the links of all of their texts (each row comes
back, with its own set's size); a null doc_id belongs to no group and is kept, its component_id is null; texts are read
whole at any length; extra columns pass through :func:`keep_one_each` whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import text as tx
from millrace.plans.checkpoints import cut, release
from millrace.plans.fixpoint import connected_components

BANDS, ROWS = 24, 4
#: Longs in a bitmap of the shingles in which a class differs from the least class of its bucket. Those it lacks are marked by
#: their place in that class's sorted set, so up to 64 * MARKS shingles none shares its mark with another; those it adds by hash.
MARKS = 8
#: Classes of a star that one task compares with all of the star, to find pairs across components.
BLOCK = 256
_COMPARED = ("linked", "n_a", "missing", "extra", *(f"gone{j}" for j in range(MARKS)), *(f"new{j}" for j in range(MARKS)))

_rng = np.random.Generator(np.random.PCG64(7))
_BINS = BANDS * ROWS
#: For each bin the order in which it tries other bins: an independent permutation each, which makes densification optimal.
_TRY = np.stack([_rng.permutation(_BINS) for _ in range(_BINS)])
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of the rows, ascending within a row, and the rows' bounds."""
    starts, _, h = tx.word_hashes(tx.LOWER[data], tx.DARK)
    first = np.searchsorted(starts, offsets)
    n_words = np.diff(first)
    size = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    bounds = np.concatenate(([0], np.cumsum(size)))
    row = np.repeat(np.arange(len(size)), size)
    place = first[row] + np.arange(len(row)) - bounds[row]
    value = np.full(len(row), k, np.uint64)
    for j in range(k):  # a row with fewer words mixes its own words only
        inside = place + j < first[row + 1]
        value = np.where(inside, value * _M1 + h[np.minimum(place + j, len(h) - 1)], value * _M2) if len(h) else value
    value = tx.mix(value)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(len(size) + 1))


def one_permutation(value: np.ndarray) -> np.ndarray:
    """Densified one-permutation sketch of one non-empty set: a value for each bin."""
    bins = (value >> np.uint64(40)) % np.uint64(_BINS)
    x = tx.mix(value * _M3)
    out = np.full(_BINS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    np.minimum.at(out, bins.astype(np.int64), x)
    full = np.zeros(_BINS, bool)
    full[bins.astype(np.int64)] = True
    if not full.all():
        empty = np.flatnonzero(~full)
        donor = _TRY[empty, full[_TRY[empty]].argmax(1)]
        out[empty] = out[donor]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """64-bit bucket of each band, for rows of sketches."""
    parts = sketch.reshape(len(sketch), BANDS, ROWS)
    key = np.zeros((len(sketch), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(1000)
    for r in range(ROWS):
        key = key * _M1 + parts[:, :, r]
    return tx.mix(key)


def sketches(docs: DataFrame, k: int, key: str, text_col: str) -> DataFrame:
    """(doc, told, n, name1, name2, keys): hash of the text, size and 128-bit name of the set, and its buckets or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in tx.chunks(batch.column(2)):
                value, bounds = shingle_sets(data, offsets, k)
                n = np.diff(bounds)
                names = []
                for x in (tx.mix(value + _M1), tx.mix(value ^ _M2)):
                    sums = np.concatenate(([np.uint64(0)], np.cumsum(x)))
                    names.append(tx.int64s((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64)))
                some = np.flatnonzero(n)
                keys: list[np.ndarray | None] = [None] * len(n)
                if len(some):
                    found = band_keys(np.stack([one_permutation(value[bounds[i] : bounds[i + 1]]) for i in some])).view(np.int64)
                    for i, x in zip(some, found, strict=True):
                        keys[i] = x
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, end - first) for c in range(2)), tx.int64s(n), *names, pa.array(keys, pa.list_(pa.int64()))], names=["doc", "told", "n", "name1", "name2", "keys"])

    return _rows(docs, key, text_col).mapInArrow(run, "doc long, told long, n long, name1 long, name2 long, keys array<long>")


def _rows(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(F.col(text_col)).alias("told"), F.col(text_col).alias("body"))


def packed(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    """(doc, told, body): texts compressed one by one, as they are moved several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([press.compress(x.as_py().encode()) for x in batch.column(2)], pa.binary())], names=["doc", "told", "body"])

    return _rows(docs, key, text_col).where("doc is not null and body is not null").mapInArrow(run, "doc long, told long, body binary")


def compare(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Every pair (a, b) compared on whole sets: linked, n_a (size of a), missing and extra (what b lacks and adds), and
    bitmaps of MARKS longs each of the shingles missing (marked by place in a's sorted set) and extra (marked by hash)."""
    right = pairs.join(texts.select(F.col("doc").alias("b"), F.col("body").alias("body_b")).hint("merge"), "b")
    both = right.join(texts.select(F.col("doc").alias("a"), F.col("body").alias("body_a")).hint("merge"), "a").select("a", "b", "body_a", "body_b")

    def marks(places: Iterable[int]) -> int:
        out = 0
        for x in places:
            out |= 1 << x % (64 * MARKS)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        read = lambda x: exact_set(expand.decompress(x.as_py()), k)
        for batch in batches:
            a, last, have, place = batch.column(0).to_pylist(), None, None, {}
            rows = []
            for i in range(len(a)):
                if a[i] != last:
                    last, have = a[i], read(batch.column(2)[i])
                    place = {x: at for at, x in enumerate(sorted(have))}
                other = read(batch.column(3)[i])
                common = len(have & other)
                gone, new = have - other, other - have
                bits = [(m >> 64 * j & 0xFFFFFFFFFFFFFFFF) for m in (marks(map(place.get, gone)), marks(map(zlib.crc32, new))) for j in range(MARKS)]
                rows.append((common > 0 and 100 * common >= percent * (len(have) + len(other) - common), len(have), len(gone), len(new), *(x - (x >> 63 << 64) for x in bits)))
            kinds = [pa.bool_(), *[pa.int64()] * (3 + 2 * MARKS)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["a", "b", *_COMPARED])

    return both.mapInArrow(run, "a long, b long, linked boolean, " + ", ".join(f"{c} long" for c in _COMPARED[1:]))


def may_link(percent: int):
    """Whether two classes x and y can be linked, given how each differs from the same class a: an upper bound of what they
    share. What either lacks of a is not shared; nor is an extra shingle whose mark the other's extras do not have."""
    count = lambda c: F.bit_count(c).cast("long")
    col = lambda c, s: F.coalesce(F.col(f"{c}_{s}"), F.lit(0))
    lost = sum((count(col(f"gone{j}", "x").bitwiseOR(col(f"gone{j}", "y"))) for j in range(MARKS)), F.lit(0))
    own = lambda s, t: col("extra", s) - sum((count(col(f"new{j}", s).bitwiseAND(F.bitwise_not(col(f"new{j}", t)))) for j in range(MARKS)), F.lit(0))
    shared = F.col("n_a") - lost + F.least(own("x", "y"), own("y", "x"))
    return shared * (100 + percent) >= percent * (F.col("n_x") + F.col("n_y"))


def exact_set(raw: bytes, k: int) -> set[bytes]:
    """The set itself, not hashes of it."""
    w = raw.translate(tx.LOWER.tobytes()).split()
    if len(w) < k:
        return {b" ".join(w)} if w else set()
    return set(map(b" ".join, zip(*(w[j:] for j in range(k)), strict=False)))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 85) -> DataFrame:
    """One row for each row of ``docs``: key, n_shingles, component_id, kept."""
    names = ["name1", "name2"]
    found = cut(sketches(docs, k, key, text_col))
    base = found.where("doc is not null and n > 0")
    sets = base.groupBy(*names).agg(F.min(F.struct("doc", "told")).alias("head"))
    named = base.join(sets, names)
    same = named.select(F.col("doc").alias("a"), F.col("head.doc").alias("b")).where("a <> b")
    # one row for each class: a text that has its set, and its buckets
    heads = named.where("doc = head.doc and told = head.told").dropDuplicates(names).select("doc", "told", "n", "keys")
    heads = cut(heads.withColumn("id", F.monotonically_increasing_id()))
    members = heads.select("id", F.explode("keys").alias("bucket"))
    least = members.groupBy("bucket").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("bucket", "a")
    shared = cut(members.join(least, "bucket"))  # (bucket, id, a): a is the least class of the bucket
    asked = cut(shared.where("a <> id").select("a", F.col("id").alias("b")).distinct())
    wanted = asked.select(F.col("a").alias("id")).union(asked.select("b")).distinct()
    bodies = heads.select("id", "doc", "told").join(wanted, "id").select("id", F.col("doc").alias("doc_"), F.col("told").alias("told_"))
    moved = packed(docs, key, text_col)
    texts = moved.join(bodies.hint("merge"), (moved["doc"] == bodies["doc_"]) & (moved["told"] == bodies["told_"]))
    texts = cut(texts.select(F.col("id").alias("doc"), "body").dropDuplicates(["doc"]))
    seen = cut(compare(asked, texts, k, percent))
    links = seen.where("linked").select("a", "b")
    part = connected_components(links, "a", "b").withColumnRenamed("node", "id")

    # buckets in which components still meet: their pairs across components, less those that the bound rules out
    parts = shared.join(part, "id", "left").select("bucket", "a", "id", F.coalesce("component", "id").alias("component"))
    parts = parts.where("id <> a")
    mixed = parts.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    open_rows = parts.join(mixed, "bucket").select("a", "id", "component").distinct()
    open_rows = open_rows.join(seen.drop("linked").withColumnRenamed("b", "id"), ["a", "id"]).withColumn("n", F.col("n_a") - F.col("missing") + F.col("extra"))
    open_rows = cut(open_rows)
    # a star's classes meet once, whichever buckets they share; large stars are dealt over tasks in blocks
    blocks = open_rows.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    each = ("id", "component", "n", *_COMPARED[2:])
    one, two = (open_rows.join(blocks, "a").select("a", "blocks", *(["n_a"] if s == "x" else []), *(F.col(c).alias(f"{c}_{s}") for c in each)) for s in "xy")
    one = one.withColumn("block", F.pmod(F.hash("id_x"), "blocks")).drop("blocks")
    two = two.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    fits = (F.col("id_x") < F.col("id_y")) & (F.col("component_x") != F.col("component_y")) & (F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * percent) & may_link(percent)
    across = one.join(two.hint("merge"), ["a", "block"]).where(fits).select(F.col("id_x").alias("a"), F.col("id_y").alias("b"))
    across = cut(across.distinct().join(asked, ["a", "b"], "left_anti"))
    more = compare(across, texts, k, percent).where("linked").select("a", "b")
    links = cut(links.union(more))
    doc_of = lambda c: heads.select(F.col("id").alias(c), F.col("doc").alias(f"doc_{c}"))
    linked = links.join(doc_of("a"), "a").join(doc_of("b"), "b").select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))
    groups = cut(connected_components(linked.union(same), "a", "b").withColumnRenamed("node", "doc"))
    for done in (heads, shared, asked, texts, seen, open_rows, across, links):
        release(done)
    out = found.select("doc", "n").join(groups, "doc", "left")
    component = F.coalesce("component", "doc")
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"))


def keep_one_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` that stay: those of the least doc_id of each group."""
    gone = near_duplicates(docs, k=k, percent=percent).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op4_near_duplicates": op4_near_duplicates}
