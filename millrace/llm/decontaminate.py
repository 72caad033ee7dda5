"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every word sequence of every item. Training words stream through it; at each word it knows the length
of the longest item passage that ends there. Where that length reaches the window (or a whole item that is shorter than a
window ends), the words of the window are hit. The automaton is a function of the benchmark alone, whose size is checked.

Defined cases: null or wordless texts have no words and no hits; items without words are ignored, repeated items and
repeated rows count each by its item_id or row; null item_ids are ignored; texts of any length are streamed whole; extra
columns pass through, and new ones whose names are taken get a trailing underscore.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import text as tx

WINDOW = 13
#: Most words that the items may have in all: a proven bound for what is broadcast.
MAX_ITEM_WORDS = 20_000_000


class Automaton:
    """Generalised suffix automaton over word ids; ``items`` are sequences of ids."""

    def __init__(self, items: list[list[int]], window: int) -> None:
        self.window = window
        self.go: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[tuple[int, int]] = []  # (state, item) for each prefix of each item
        whole: list[tuple[int, int]] = []
        for i, seq in enumerate(items):
            last = 0
            for w in seq:
                last = self._extend(last, w)
                ends.append((last, i))
            if 0 < len(seq) < window:
                whole.append((last, i))
        n = len(self.len)
        owners: list[set[int]] = [set() for _ in range(n)]
        for state, i in ends:
            owners[state].add(i)
        self.order = sorted(range(1, n), key=self.len.__getitem__)
        for s in reversed(self.order):  # a state's items also hold the shorter sequences its link stands for
            if self.len[self.link[s]] >= window:
                owners[self.link[s]] |= owners[s]
        #: Items that hold the window which ends where this state stands, if it is that long.
        self.items: list[frozenset[int]] = [frozenset()] * n
        #: Short items, as (length, item), that end where this state stands.
        self.short: list[tuple[tuple[int, int], ...]] = [()] * n
        own: dict[int, list[tuple[int, int]]] = {}
        for state, i in whole:
            own.setdefault(state, []).append((len(items[i]), i))
        for s in self.order:
            p = self.link[s]
            if self.len[s] >= window:
                self.items[s] = self.items[p] if self.len[p] >= window else frozenset(owners[s])
            self.short[s] = self.short[p] + tuple(own.get(s, ()))

    def _extend(self, last: int, w: int) -> int:
        go, link, length = self.go, self.link, self.len
        if w in go[last]:
            q = go[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, q, w)
        cur = len(length)
        go.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in go[p]:
            go[p][w] = cur
            p = link[p]
        if p >= 0:
            q = go[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, w)
        return cur

    def _split(self, p: int, q: int, w: int) -> int:
        clone = len(self.len)
        self.go.append(dict(self.go[q])), self.link.append(self.link[q]), self.len.append(self.len[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.go[p].get(w) == q:
            self.go[p][w] = clone
            p = self.link[p]
        return clone

    def scan(self, seq: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit stretches [start, end) of word places, in order of their ends, and the items hit."""
        go, link, length, window = self.go, self.link, self.len, self.window
        state, n, spans, items = 0, 0, [], set()
        for at, w in enumerate(seq):
            while state and w not in go[state]:
                state = link[state]
                n = length[state]
            state = go[state].get(w, 0)
            n = n + 1 if state else 0
            if not state:
                continue
            for size, i in self.short[state]:
                if size <= n:
                    spans.append((at + 1 - size, at + 1))
                    items.add(i)
            if n >= window:
                spans.append((at + 1 - window, at + 1))
                items |= self.items[state]
        return spans, items


def _tokens(text: str | None) -> list[bytes]:
    if not text:
        return []
    data = np.append(tx.LOWER[np.frombuffer(text.encode(), np.uint8)], np.uint8(10))
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(*tx.words(data, tx.ALNUM), strict=True)]


class Model:
    """Automaton, the words' ids and, to pass over what cannot match, the hashes of the items' words and word pairs."""

    def __init__(self, rows: list[tuple[int, str | None]], window: int = WINDOW) -> None:
        rows = sorted(((i, t or "") for i, t in rows if i is not None), key=lambda r: (str(r[0]), r[1]))
        split = [(i, _tokens(t)) for i, t in rows]
        split = [(i, s) for i, s in split if s]
        self.ids = [i for i, _ in split]
        self.vocabulary: dict[bytes, int] = {}
        seqs = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in s] for _, s in split]
        self.least = min((min(len(s), window) for s in seqs), default=0)
        self.automaton = Automaton(seqs, window)
        flat = b"\n".join(self.vocabulary) + b"\n"
        _, _, hashes = tx.word_hashes(np.frombuffer(flat, np.uint8), tx.ALNUM)
        pairs = [np.array(s, np.int64) for s in seqs if len(s) > 1]
        self.words = np.unique(hashes)
        self.pairs = np.unique(np.concatenate([pair_hashes(hashes[s]) for s in pairs])) if pairs else np.zeros(0, np.uint64)


def pair_hashes(h: np.ndarray) -> np.ndarray:
    return tx.mix(h[:-1] * np.uint64(3) + h[1:])


def _member(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def _scan_chunk(model: Model, data: np.ndarray, offsets: np.ndarray):
    """Per row of the chunk: (words, hit places as stretches, items)."""
    data = tx.LOWER[data]
    starts, ends, hashes = tx.word_hashes(data, tx.ALNUM)
    first = np.searchsorted(starts, offsets)  # first word of each row, and the end
    found: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
    if model.least and len(starts):
        # a run of words can only match if all its neighbours are neighbours in some item
        if model.least == 1:
            good = _member(model.words, hashes)
            run_a = np.flatnonzero(good & ~np.concatenate(([False], good[:-1])))
            run_b = np.flatnonzero(good & ~np.concatenate((good[1:], [False]))) + 1
        else:
            good = _member(model.pairs, pair_hashes(hashes))
            row_start = first[(first > 0) & (first < len(starts))]
            good[row_start - 1] = False  # a pair across rows
            edge = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
            run_a, run_b = edge[0::2], edge[1::2] + 1
        keep = run_b - run_a >= model.least
        raw = data.tobytes()
        vocabulary = model.vocabulary
        row_of = np.searchsorted(first, run_a[keep], "right") - 1
        for a, b, row in zip(run_a[keep].tolist(), run_b[keep].tolist(), row_of.tolist(), strict=True):
            while a < b:  # with least 1 a run may go on into the next row
                stop = min(b, int(first[row + 1]))
                seq = [vocabulary.get(raw[s:e], -1) for s, e in zip(starts[a:stop].tolist(), ends[a:stop].tolist(), strict=True)]
                spans, items = model.automaton.scan(seq)
                if spans:
                    all_spans, all_items = found.setdefault(row, ([], set()))
                    all_spans += [(s + a - int(first[row]), e + a - int(first[row])) for s, e in spans]
                    all_items |= items
                a, row = stop, row + 1
    return np.diff(first), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def build_model(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, max_item_words: int = MAX_ITEM_WORDS) -> Model:
    n = benchmark.select(F.sum(F.regexp_count(text_col, F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")))).first()[0] or 0
    if n > max_item_words:
        raise ValueError(f"the benchmark has {n} words; one automaton is built for at most {max_item_words}")
    return Model([(r[0], r[1]) for r in benchmark.select(item_col, text_col).collect()], window)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_hit, spans (array of [start, end) word places) and items (sorted as strings)."""
    model = docs.sparkSession.sparkContext.broadcast(build_model(benchmark, window=window))
    schema = tx.extended(docs, "n_words bigint, n_hit bigint, spans array<array<bigint>>, items array<string>")
    names, where = schema.names, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            n_words, n_hit, spans, items = [], [], [], []
            for _, _, data, offsets in tx.chunks(batch.column(where)):
                counts, found = _scan_chunk(m, data, offsets)
                n_words += counts.tolist()
                for row in range(len(counts)):
                    s, i = found.get(row, ((), ()))
                    s = merged(s)
                    spans.append([list(x) for x in s])
                    n_hit.append(sum(b - a for a, b in s))
                    items.append(sorted({str(m.ids[x]) for x in i}))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))],
                names=names,
            )

    return docs.mapInArrow(run, schema)


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words") -> "F.Column":
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, with the columns of ``docs``."""
    found = find_contamination(docs, benchmark)
    n_words, n_hit = found.columns[-4:-2]
    return found.where(~contaminated(n_hit, n_words)).select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, longest: int = WINDOW, coverage: float = 0.05) -> DataFrame:
    """``docs`` with texts from which found spans are cut: those of at least ``longest`` words, and all spans of a text whose
    words they cover to at least the share ``coverage``. A span goes from its first word's first byte to its last word's last;
    what stands around it stays. Null texts stay null."""
    model = docs.sparkSession.sparkContext.broadcast(build_model(benchmark, window=window))
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for first, end, data, offsets in tx.chunks(batch.column(where)):
                counts, found = _scan_chunk(model.value, data, offsets)
                starts, ends = tx.words(tx.LOWER[data], tx.ALNUM) if found else ((), ())
                for row in range(end - first):
                    raw = data[offsets[row] : offsets[row + 1] - 1]
                    spans = merged(found[row][0]) if row in found else []
                    if sum(b - a for a, b in spans) < coverage * counts[row]:
                        spans = [(a, b) for a, b in spans if b - a >= longest]
                    if spans:
                        word = int(np.searchsorted(starts, offsets[row]))
                        keep = np.ones(len(raw), bool)
                        for a, b in spans:
                            keep[starts[word + a] - offsets[row] : ends[word + b - 1] - offsets[row]] = False
                        raw = raw[keep]
                    texts.append(raw.tobytes().decode() if batch.column(where)[first + row].is_valid else None)
            columns = list(batch.columns)
            columns[where] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=docs_names)

    docs_names = docs.columns
    return docs.mapInArrow(run, docs.schema)


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


QUERIES = {"op6_decontaminate": op6_decontaminate}

OP6_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bk AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS t FROM bk),
sizes AS (SELECT DISTINCT n FROM win),
dk AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM w, sizes WHERE len(w) >= n),
dw AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS t FROM dk),
hits AS (SELECT dw.doc_id, dw.n, dw.k, win.item_id FROM dw JOIN win ON dw.t = win.t AND dw.n = win.n),
places AS (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS p FROM hits),
c AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.w) AS contaminated
FROM w LEFT JOIN c ON w.doc_id = c.doc_id LEFT JOIN i ON w.doc_id = i.doc_id
"""

SQL = {"op6_decontaminate": OP6_SQL}
