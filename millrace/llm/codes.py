"""Compressing vectors to one code a part (product quantisation) in whole numbers, with exact nearest entries by trees.

Components become floor(SCALE * x); a vector is cut into ``PARTS`` equal consecutive parts. Each part position has a codebook
of up to ``ENTRIES`` entries, at first the parts of the kept vectors of least id. Each of ``ROUNDS`` rounds assigns every part
to its nearest entry (squared Euclidean distance, ties to the lower index) and replaces every entry that was used by the
floored mean of its parts; at the end parts are assigned once more.

The method: the driver builds a vantage-point tree over the entries of each part position. An inner node keeps one entry, and
the least and largest distance from it to the entries of its near and of its far child; distances are metric, so a query at
distance d from the vantage entry is at least max(d - largest, least - d) from a child's entries. A batch of queries goes down
together, each to the child with the lower bound first, and visits the other one if its bound does not exceed the best
distance found (equal counts as a visit, as an equal distance may have a lower index). Bounds are floating point, kept radii
are rounded outwards and bounds inwards by far more than their error; all comparisons that decide are of exact 64-bit
integers. Sums of parts are made per task and entry, then added up by Spark; only the codebooks (``ENTRIES`` times the number
of components) reach the driver, and only they and the trees are broadcast, whatever the number of vectors.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped. The dimension is that of the kept
vector of least id; vectors of another length stay, with null code and error, and take no part in anything else. A dimension
that can't be cut into equal parts is an error. Null ids come after all others; of rows with equal id the lesser vector comes
first; repeated rows each count. With fewer vectors than entries the codebooks are shorter. An empty table, or one in which
every row is dropped, gives no rows. Components beyond 2**27 / SCALE are an error, as squares would not fit into 64 bits (nor
would more than some hundred components a part at that size). Extra columns pass through; a new column whose name is taken
gets a trailing underscore.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import text as tx
from millrace.plans.checkpoints import cut, small

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
LEAF = 8
LARGEST = 1 << 27
#: Relative error allowed for in every floating-point distance; true errors are below 2**-50.
SLACK = 1e-12


class Tree:
    """A vantage-point tree over the rows of an integer array."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(len(entries)))

    def _build(self, members: np.ndarray) -> int:
        if len(members) <= LEAF:
            self.nodes.append((None, members))
            return len(self.nodes) - 1
        # the vantage entry is one far from the rest's middle; the others are halved by their distance from it
        middle = self.entries[members].mean(0)
        vantage = members[((self.entries[members] - middle) ** 2).sum(1).argmax()]
        rest = members[members != vantage]
        far = np.sqrt(((self.entries[rest] - self.entries[vantage]) ** 2).sum(1).astype(float))
        order = np.argsort(far, kind="stable")
        children = []
        for half in (order[: len(order) // 2], order[len(order) // 2 :]):
            inner, outer = far[half].min() * (1 - SLACK), far[half].max() * (1 + SLACK)
            children.append((self._build(np.sort(rest[half])), inner, outer))
        self.nodes.append((int(vantage), children))
        return len(self.nodes) - 1

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of and squared distance to the nearest entry of each query; of equals the lowest index."""
        best = np.full(len(queries), np.iinfo(np.int64).max)
        index = np.full(len(queries), len(self.entries))

        def better(who: np.ndarray, distance: np.ndarray, entry: np.ndarray | int) -> None:
            wins = (distance < best[who]) | ((distance == best[who]) & (entry < index[who]))
            best[who[wins]] = distance[wins]
            index[who[wins]] = entry[wins] if isinstance(entry, np.ndarray) else entry

        def visit(node: int, who: np.ndarray) -> None:
            if not len(who):
                return
            vantage, below = self.nodes[node]
            if vantage is None:
                gaps = queries[who, None, :] - self.entries[below]
                squares = np.einsum("ijk,ijk->ij", gaps, gaps)
                at = squares.argmin(1)  # members ascend, so the first of equals has the lowest index
                better(who, squares[np.arange(len(who)), at], below[at])
                return
            gaps = queries[who] - self.entries[vantage]
            squares = np.einsum("ij,ij->i", gaps, gaps)
            better(who, squares, vantage)
            d = np.sqrt(squares.astype(float))
            bounds = [np.maximum(0, np.maximum(d * (1 - SLACK) - outer, inner - d * (1 + SLACK))) for _, inner, outer in below]
            first = bounds[1] < bounds[0]  # whether the far child comes first
            for k in (0, 1):
                visit(below[k][0], who[first == bool(k)])
            for k in (0, 1):
                later = first != bool(k)
                later &= bounds[k] ** 2 * (1 - SLACK) <= best[who]
                visit(below[k][0], who[later])

        visit(self.root, np.arange(len(queries)))
        return index, best


def _integers(column: pa.Array, dimension: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have the dimension, and their components as integers."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dimension), False).to_numpy(zero_copy_only=False)
    values = column.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.floor(scale * values)
    if len(whole) and np.abs(whole).max() > LARGEST:
        raise OverflowError(f"a component is beyond {LARGEST / scale}")
    return fits, whole.astype(np.int64).reshape(int(fits.sum()), dimension)


def kept(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null and has neither nulls nor non-finite components."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.where(F.col(vector).isNotNull() & ~F.coalesce(F.exists(vector, odd), F.lit(False)))


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def codebooks(vectors: DataFrame, vector: str, key: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray | None:
    """The entries of all parts, an array of (parts, entries, components a part), from kept vectors; None if there are none."""
    ordered = vectors.select(F.col(key).alias("k"), F.col(vector).alias("v")).orderBy(F.col("k").asc_nulls_last(), "v")
    least = ordered.limit(1).collect()
    if not least:
        return None
    dimension = len(least[0].v)
    if dimension % parts:
        raise ValueError(f"{dimension} components can't be cut into {parts} equal parts")
    same = vectors.select(F.col(key).alias("k"), F.col(vector).alias("v")).where(F.size("v") == dimension)
    first = same.orderBy(F.col("k").asc_nulls_last(), "v").limit(entries).select("v").collect()
    width = dimension // parts
    start = np.array([r.v for r in first], np.float64).reshape(len(first), parts, width)
    if len(start) and np.abs(start).max(initial=0) * scale > LARGEST:
        raise OverflowError(f"a component is beyond {LARGEST / scale}")
    books = np.floor(scale * start).astype(np.int64).transpose(1, 0, 2).copy()
    n_entries = books.shape[1]
    spark = vectors.sparkSession
    for _ in range(rounds):
        trees = spark.sparkContext.broadcast([Tree(b) for b in books])

        def add(batches: Iterator[pa.RecordBatch], trees=trees) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros((parts, n_entries, width), np.int64), np.zeros((parts, n_entries), np.int64)
            for batch in _batches(batches):
                _, whole = _integers(batch.column(0), dimension, scale)
                for p in range(parts):
                    part = whole[:, p * width : (p + 1) * width]
                    index, _ = trees.value[p].nearest(part)
                    order = np.argsort(index, kind="stable")
                    used, at, n = np.unique(index[order], return_index=True, return_counts=True)
                    if len(used):
                        sums[p, used] += np.add.reduceat(part[order], at, axis=0)
                        counts[p, used] += n
            p, e = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), tx.int64s(counts[p, e]), pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

        by_task = same.select("v").mapInArrow(add, "part int, entry int, n long, sums array<long>")
        counts = [F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), *(F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width))]
        for r in by_task.groupBy("part", "entry").agg(*counts).collect():  # at most parts * entries rows
            books[r.part, r.entry] = [int(r[f"s{i}"]) // int(r.n) for i in range(width)]
        trees.unpersist()
    return books


def encode(vectors: DataFrame, books: np.ndarray, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vectors``, all kept, with code (the index of the nearest entry of each part, two hexadecimal digits each, or as many
    as the codebook needs) and error (squared distances, summed over parts)."""
    parts, n_entries, width = books.shape
    trees = vectors.sparkSession.sparkContext.broadcast([Tree(b) for b in books])
    digits = max(2, len(f"{n_entries - 1:x}"))
    schema = tx.extended(vectors, "code string, error long")
    where = vectors.columns.index(vector)
    words = np.array([f"{i:0{digits}x}" for i in range(n_entries)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            fits, whole = _integers(batch.column(where), parts * width, scale)
            found = [trees.value[p].nearest(whole[:, p * width : (p + 1) * width]) for p in range(parts)]
            text, error = np.full(len(fits), None, object), np.zeros(len(fits), np.int64)
            code = words[found[0][0]]
            for index, _ in found[1:]:
                code = np.char.add(code, words[index])
            text[fits], error[fits] = code, sum(d for _, d in found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text.tolist(), pa.string()), pa.array(error, pa.int64(), mask=~fits)], names=schema.names)

    return vectors.mapInArrow(run, schema)


def decode(books: np.ndarray, code: str) -> list[int]:
    """The integer components that a code stands for."""
    digits = len(code) // len(books)
    return [int(x) for p, book in enumerate(books) for x in book[int(code[p * digits : (p + 1) * digits], 16)]]


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def label_errors(coded: DataFrame, label: str = "label", error: str = "error") -> DataFrame:
    """(label, label_error): errors summed over equal labels, nulls together."""
    return coded.groupBy(label).agg(F.coalesce(F.sum(error), F.lit(0)).alias("label_error"))


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    rows = kept(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"), "embedding")
    books = codebooks(rows, "embedding", "vec_id")
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = cut(encode(rows, books).select("vec_id", "label", "code", "error"))
    sums = small(label_errors(coded).withColumnRenamed("label", "_label"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


QUERIES = {"op12_vector_codes": op12_vector_codes}
