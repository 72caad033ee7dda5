"""Language identification with interpolated Kneser-Ney character models.

Texts become lower-case letters with single spaces between words. One model of order ``ORDER`` per language is estimated
from all n-gram counts, which executors gather over all labelled rows: none is left out, so every labelled language with a
letter has its model, and the driver and the broadcast hold a row of each distinct n-gram; a text goes to the language with
the least cross-entropy per character. Models are sorted arrays of n-gram hashes with a row of log probabilities (one per
language) for each n-gram.

Rejection is calibrated on folds of the labelled rows: models of one fold score the other, and a language's limit is the
``ACCEPTED`` quantile of what its texts cost beyond the model's own cross-entropy, less what chance adds at their length. A
language with fewer than ``ENOUGH`` texts in the scored fold has the distance of the nearest foreign language as its limit.

Defined cases: a null text, or one without letters, is ``und`` with score 0 and rejected; with no labelled row at all
everything is ``und``; rows without a label are not learned from; repeated rows count each, rows with equal doc_id are in one
fold; a null doc_id is learned from and never calibrates; a text of any length is scored whole; extra columns pass through,
and new ones whose names are taken get a trailing underscore.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import text as tx

ORDER = 4
#: Share of a language's labelled texts that its limit accepts.
ACCEPTED = 0.999
#: Texts that a quantile is read from, at least.
ENOUGH = 200
#: Standard deviations that chance may add to a text's mean cost.
CHANCE = 3
#: Bytes of text that a task has at hand at once; the arrays made of them in `gram_counts` take 80 times that.
CHUNK = 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)


def letter_table() -> np.ndarray:
    """Code point -> lower-case code point for letters, space for everything else."""
    table = np.full(0x110000, 0x20, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            table[cp] = ord(low[0]) if unicodedata.category(low[0])[0] == "L" else cp
    return table


def letters(table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised code points of the rows, each after ORDER - 1 spaces and before one; the rows' bounds; their letters."""
    points = table[np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    at = np.searchsorted(heads, offsets)
    blank = points == 0x20
    after_blank = np.concatenate(([True], blank[:-1]))
    after_blank[at[:-1]] = True  # spaces at the start of a row, which the padding stands for
    keep = ~(blank & after_blank)
    kept = np.concatenate(([0], np.cumsum(keep)))
    sizes = kept[at[1:]] - kept[at[:-1]]
    pad = ORDER - 1
    bounds = np.concatenate(([0], np.cumsum(sizes + pad)))
    out = np.full(int(bounds[-1]), 0x20, np.uint32)
    place = np.ones(len(out), bool)
    for k in range(pad):
        place[bounds[:-1] + k] = False
    out[place] = points[keep]
    return out, bounds, np.add.reduceat(~blank, at[:-1]) if len(at) > 1 else np.zeros(0, int)


def gram_hashes(points: np.ndarray, order: int, drop: int = 0) -> np.ndarray:
    """Hash of the ``order`` code points that end ``drop`` before each place from ORDER - 1 on."""
    n = len(points) - ORDER + 1
    h = np.full(n, order, np.uint64)
    for k in range(order):
        a = ORDER - drop - order + k
        h = h * _STEP + points[a : a + n]
    return tx.mix(h)


class Table:
    """Sorted hashes, found through the first hash of each range of leading bits."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = np.append(hashes[self.order], np.uint64(0xFFFFFFFFFFFFFFFF))
        bits = max(1, int(len(hashes)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.hashes[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of each value, or -1."""
        at = self.first[values >> self.shift]
        seen = self.hashes[at]
        out = np.where(seen == values, at, -1)
        more = np.flatnonzero(seen < values)
        while len(more):
            at[more] += 1
            seen = self.hashes[at[more]]
            out[more[seen == values[more]]] = at[more][seen == values[more]]
            more = more[seen < values[more]]
        out[out == len(self.hashes) - 1] = -1
        return out


@dataclass
class Models:
    languages: list[str]
    letters: np.ndarray
    #: By order 1..ORDER: n-grams with log P(last | rest), one column per language.
    tables: list[Table]
    log_p: list[np.ndarray]
    #: By order 2..ORDER: contexts with the log weight of the next lower order.
    contexts: list[Table]
    log_back: list[np.ndarray]
    #: log P of a character that no model has seen.
    floor: np.ndarray
    own: np.ndarray
    spread: np.ndarray
    limit: np.ndarray

    def log_probs(self, points: np.ndarray) -> np.ndarray:
        """log P of each place from ORDER - 1 on, by language."""
        n = len(points) - ORDER + 1
        out = np.zeros((n, len(self.languages)), np.float32)
        at = self.tables[ORDER - 1].find(gram_hashes(points, ORDER))
        out[:] = self.log_p[ORDER - 1][at]
        left = np.flatnonzero(at < 0)
        if len(left):
            windows = np.lib.stride_tricks.sliding_window_view(points, ORDER)[left]
            rest = np.zeros((len(left), len(self.languages)), np.float32)
            todo = np.arange(len(left))
            for order in range(ORDER, 0, -1):
                flat = windows[todo].reshape(-1)
                if order < ORDER:
                    found = self.tables[order - 1].find(gram_hashes(flat, order)[::ORDER])
                    hit = found >= 0
                    rest[todo[hit]] += self.log_p[order - 1][found[hit]]
                    todo = todo[~hit]
                    if not len(todo):
                        break
                    flat = windows[todo].reshape(-1)
                if order > 1:
                    found = self.contexts[order - 2].find(gram_hashes(flat, order - 1, 1)[::ORDER])
                    hit = found >= 0
                    rest[todo[hit]] += self.log_back[order - 2][found[hit]]
                else:
                    rest[todo] += self.floor
            out[left] = rest
        return out


def gram_counts(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, n) over all rows that have a label; each task adds up what it reads before anything is shuffled."""
    table = labelled.sparkSession.sparkContext.broadcast(letter_table())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        seen = Table(np.zeros(0, np.uint64))
        keys, totals, grams, langs = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, ORDER), np.uint32), np.zeros(0, np.int64)
        waiting: list[tuple[np.ndarray, ...]] = []  # new n-grams of the last chunks: the table is not sorted again for each

        def take_in() -> None:
            nonlocal seen, keys, totals, grams, langs
            if waiting:
                more, n, points, lang = (np.concatenate(x) for x in zip(*waiting, strict=True))
                new, index, inverse = np.unique(more, return_index=True, return_inverse=True)
                sums = np.zeros(len(new), np.int64)
                np.add.at(sums, inverse, n)
                keys, totals = np.concatenate((keys, new)), np.concatenate((totals, sums))
                grams, langs = np.concatenate((grams, points[index])), np.concatenate((langs, lang[index]))
                seen = Table(keys)
                waiting.clear()

        for batch in batches:
            codes = np.array([names.setdefault(x, len(names)) for x in batch.column(1).to_pylist()], np.int64)
            for first, end, data, offsets in tx.chunks(batch.column(0), CHUNK):
                points, bounds, n_letters = letters(table.value, data, offsets)
                if len(points) < ORDER:
                    continue
                h = gram_hashes(points, ORDER)
                row = np.repeat(np.arange(end - first), np.diff(bounds))[: len(h)]
                good = np.ones(len(h), bool)
                for k in range(1, ORDER):  # places whose n-gram would reach into the next row
                    cut = bounds[1:-1] - k
                    good[cut[cut < len(h)]] = False
                good &= n_letters[row] > 0
                place = np.flatnonzero(good)
                lang = codes[first + row[place]]
                key = tx.mix(h[place] + lang.astype(np.uint64) * _STEP)
                found = seen.find(key)
                hit = found >= 0
                if len(totals):
                    totals += np.bincount(seen.order[found[hit]], minlength=len(totals))
                if not hit.all():
                    fresh, index, n = np.unique(key[~hit], return_index=True, return_counts=True)
                    at = place[~hit][index]
                    waiting.append((fresh, n, np.stack([points[at + k] for k in range(ORDER)], 1), lang[~hit][index]))
                    if sum(len(w[0]) for w in waiting) > max(1 << 16, len(keys) // 2):
                        take_in()
        take_in()
        if len(keys):
            by = list(names)
            text = grams.astype("<u4").reshape(-1).view(f"<U{ORDER}")
            for a in range(0, len(keys), 50_000):
                b = a + 50_000
                yield pa.RecordBatch.from_arrays(
                    [pa.array([by[x] for x in langs[a:b]], pa.string()), pa.array([str(x).ljust(ORDER) for x in text[a:b]], pa.string()), pa.array(totals[a:b], pa.int64())], names=["lang", "gram", "n"])

    counts = labelled.where(F.col(lang_col).isNotNull()).select(text_col, lang_col).mapInArrow(run, "lang string, gram string, n long")
    return counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discount(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Models:
    rows = gram_counts(labelled, text_col, lang_col).toPandas()
    languages = sorted(set(rows["lang"]))
    n_lang = len(languages)
    points = np.frombuffer("".join(rows["gram"]).encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
    lang = rows["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64) if len(rows) else np.zeros(0, np.int64)
    count = rows["n"].to_numpy(np.int64)

    # counts by order: the highest has occurrences, lower ones have the number of distinct left neighbours
    by_order: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros((0, 0), np.uint32), np.zeros((0, 0)))] * (ORDER + 1)
    grams, inverse = np.unique(points, axis=0, return_inverse=True)
    full = np.zeros((len(grams), n_lang))
    np.add.at(full, (inverse.reshape(-1), lang), count)
    by_order[ORDER] = (grams, full)
    for order in range(ORDER - 1, 0, -1):
        above, value = by_order[order + 1]
        grams, inverse = np.unique(above[:, 1:], axis=0, return_inverse=True)
        kinds = np.zeros((len(grams), n_lang))
        np.add.at(kinds, inverse.reshape(-1), (value > 0).astype(float))
        by_order[order] = (grams, kinds)

    alphabet = len(by_order[1][0]) + 1
    floor = np.full(n_lang, -np.log(alphabet))
    tables, log_p, contexts, log_back = [], [], [], []
    lower = np.zeros(0)
    for order in range(1, ORDER + 1):
        grams, value = by_order[order]
        discount = np.array([_discount(value[:, k]) for k in range(n_lang)])
        context, which = np.unique(grams[:, :-1], axis=0, return_inverse=True) if order > 1 else (np.zeros((1, 0), np.uint32), np.zeros(len(grams), np.int64))
        which = which.reshape(-1)
        total, kinds = np.zeros((len(context), n_lang)), np.zeros((len(context), n_lang))
        np.add.at(total, which, value)
        np.add.at(kinds, which, (value > 0).astype(float))
        safe = np.maximum(total, 1)
        back = np.where(total > 0, discount * kinds / safe, 1.0)
        below = np.full(len(grams), 1 / alphabet)[:, None] if order == 1 else lower[_rows(by_order[order - 1][0], grams[:, 1:])]
        p = np.where(total[which] > 0, np.maximum(value - discount, 0) / safe[which], 0) + back[which] * below
        lower = p
        table = Table(_hash_rows(grams))
        tables.append(table)
        log_p.append(np.log(np.maximum(p, 1e-12)).astype(np.float32)[table.order])
        if order == 1:
            floor = floor + np.log(np.maximum(back[0], 1e-12))
        else:
            table = Table(_hash_rows(context))
            contexts.append(table)
            log_back.append(np.log(np.maximum(back, 1e-12)).astype(np.float32)[table.order])
    # what a text of each language costs under each model, from the same counts
    full, cost = by_order[ORDER][1], -np.log(np.maximum(lower, 1e-12)) if n_lang else np.zeros((0, 0))
    share = full / np.maximum(full.sum(0), 1)
    mean = share.T @ cost  # of language i under model j
    own = np.diag(mean).copy() if n_lang else np.zeros(0)
    spread = np.sqrt(np.maximum((share * cost**2).sum(0) - own**2, 0)) if n_lang else np.zeros(0)
    foreign = np.where(np.eye(n_lang, dtype=bool), np.inf, mean).min(0) if n_lang > 1 else np.full(n_lang, 2 * np.log(alphabet))
    return Models(languages, letter_table(), tables, log_p, contexts, log_back, floor, own, spread, own + np.maximum(foreign - own, 0.5))


def _rows(table: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted row in a table of distinct sorted rows."""
    t = Table(_hash_rows(table))
    return t.order[t.find(_hash_rows(wanted))]


def _hash_rows(grams: np.ndarray) -> np.ndarray:
    h = np.full(len(grams), grams.shape[1], np.uint64)
    for k in range(grams.shape[1]):
        h = h * _STEP + grams[:, k]
    return tx.mix(h)


def identify(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score, cross_entropy (nats a character), excess (of it beyond the model's own and what chance
    adds) and rejected."""
    model = docs.sparkSession.sparkContext.broadcast(models)
    schema = tx.extended(docs, "lang_pred string, score double, cross_entropy double, excess double, rejected boolean")
    names, where = schema.names, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Models = model.value
        for batch in batches:
            best, score, entropy, excess, rejected = [], [], [], [], []
            for first, end, data, offsets in tx.chunks(batch.column(where), CHUNK):
                points, bounds, n_letters = letters(m.letters, data, offsets)
                rows = end - first
                if not m.languages or not n_letters.any():
                    best += ["und"] * rows
                    score += [0.0] * rows
                    entropy += [None] * rows
                    excess += [None] * rows
                    rejected += [True] * rows
                    continue
                logs = np.cumsum(np.vstack((np.zeros((1, len(m.languages))), m.log_probs(points))), 0, dtype=np.float64)
                n = np.maximum(np.diff(bounds) - ORDER + 1, 1)
                low = np.minimum(bounds[:-1], len(logs) - 1)
                high = np.clip(bounds[1:] - ORDER + 1, low, len(logs) - 1)
                cost = -(logs[high] - logs[low]) / n[:, None]
                pick = cost.argmin(1)
                least = cost[np.arange(rows), pick]
                odds = np.exp(np.maximum(-(cost - least[:, None]) * n[:, None], -700))
                sure = 1 / odds.sum(1)
                over = least - m.own[pick] - CHANCE * m.spread[pick] / np.sqrt(n)
                bad = over > (m.limit - m.own)[pick]
                for i in range(rows):
                    known = n_letters[i] > 0
                    best.append(m.languages[pick[i]] if known else "und")
                    score.append(float(sure[i]) if known else 0.0)
                    entropy.append(float(least[i]) if known else None)
                    excess.append(float(over[i]) if known else None)
                    rejected.append(bool(bad[i]) or not known)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(excess, pa.float64()), pa.array(rejected, pa.bool_())], names=names)

    return docs.mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def calibrated(labelled: DataFrame, key: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Models:
    """Models of all labelled rows, with limits read from one fold of them as models of the other fold score it."""
    models = fit(labelled, text_col, lang_col)
    fold = F.coalesce(F.crc32(F.concat(F.lit("fold "), F.col(key).cast("string"))) % 2 == 1, F.lit(False))
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), fold.alias("fold"))
    half = fit(rows.where("not fold"), "text", "lang")
    told = identify(rows.where("fold").select("text", "lang"), half).where("lang = lang_pred")
    limits = told.groupBy("lang").agg(F.count("*").alias("n"), F.percentile_approx("excess", F.lit(ACCEPTED), F.lit(10_000)).alias("limit"))
    for r in limits.where(F.col("n") >= ENOUGH).collect():  # one row a language
        at = models.languages.index(r.lang)
        models.limit[at] = models.own[at] + max(r.limit, 0.0)
    return models


def keep_identified(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows whose language is identified, with the columns of ``docs``."""
    found = identify(docs, calibrated(docs.where(~held_out()), text_col=text_col, lang_col=lang_col), text_col)
    return found.where(~F.col(found.columns[-1])).select(*docs.columns)


def op3_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    models = calibrated(docs.where(~held_out()).select("doc_id", "text", "lang"))
    out = identify(docs.select("doc_id", "text"), models)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


QUERIES = {"op3_language": op3_language}
