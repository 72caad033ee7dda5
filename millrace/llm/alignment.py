"""Aligning the tokens of two tokenizers over the same text.

Tokenizer A is a byte-level BPE given as JSON, B a piece model with byte fallback. Both tile the bytes of a space and the text;
where a token of A and one of B end at the same byte, both are cut, and what lies between two cuts is a group. The method:
packed bitsets of 64-bit words mark the bytes at which tokens end, one per tokenizer for a run of texts; their AND has the
shared cuts; selecting its bits gives the bytes of the cuts, and popcounts (a running count per word and the bits below within
it) rank these bytes among the token ends, which maps every group to a range of tokens on either side. A group's links are all
its pairs of a token of A and one of B. They are expanded for at most ``LINKS`` links at a time, or those of one token, and
gathered as distinct pairs with their number, so a text whose tokens never meet needs no more memory than its distinct pairs.

Counts of pairs over the corpus are sums of Spark over the distinct pairs of every text, pre-aggregated before the shuffle; the
table of counts is bounded by pairs that occur, so it is broadcast only if it has few rows (``checkpoints.small``), else the
join is a shuffle. No group of texts meets in one task.

A's tokens come from the faster of two public encoders wherever both split text alike (characters below U+0250) and the
vocabulary is in the order of its merges; all other texts take the encoder of the JSON file.

Defined cases: null and empty texts, invalid UTF-8, and texts whose tokens don't spell a space and the text again (B spells
U+2581 as a space) have no tokens: all numbers 0, groups the empty string, no pairs. Every row counts as a document by itself,
also rows with equal or null doc_id. Of pairs with equal counts all are best. An empty table has no rows and no pairs. Texts of
any length are encoded whole. Extra columns pass through; a new column whose name is taken gets a trailing underscore.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import text as tx
from millrace.plans.checkpoints import cut, small

TOKENIZERS = "/opt/tokenizers"
#: Links that are expanded at once.
LINKS = 1 << 20
# Fixed value: how byte-level vocabularies of this kind split text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
COLUMNS = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Spelling:
    """Bytes of every token of a vocabulary, in one buffer."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def spell(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        return self.blob[np.arange(n.sum()) + np.repeat(self.start[ids] - (np.cumsum(n) - n), n)]


class Tokenizers:
    """Both tokenizers, from the bytes of their files; what is built from them stays with a Python worker."""

    def __init__(self, a: bytes, b: bytes) -> None:
        self.files = a, b

    def __reduce__(self):
        return Tokenizers, self.files

    @cached_property
    def _json(self) -> dict:
        return json.loads(self.files[0])

    @cached_property
    def a_tokens(self) -> list[bytes]:
        letters, vocab = byte_letters(), self._json["model"]["vocab"]
        names = {i: t for t, i in vocab.items()} | {x["id"]: None for x in self._json["added_tokens"]}
        added = {x["id"]: x["content"].encode() for x in self._json["added_tokens"]}
        return [added.get(i, b"") if names.get(i) is None else bytes(letters[c] for c in names[i]) for i in range(max(names) + 1)]

    @cached_property
    def b_model(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.files[1])

    @cached_property
    def a_spelling(self) -> Spelling:
        return Spelling(self.a_tokens)

    @cached_property
    def b_spelling(self) -> Spelling:
        m = self.b_model
        return Spelling([bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, m.id_to_piece(i)) for i in range(m.get_piece_size()))])

    @cached_property
    def a_exact(self):
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(self.files[0].decode())
        t.encode_special_tokens = True
        return t

    @cached_property
    def a_fast(self):
        """An encoder by rank, if ids are ranks: each merge makes the next id; else None."""
        import tiktoken

        model, spelt = self._json["model"], self.a_tokens
        made = [model["vocab"].get("".join(m.split(" ", 1) if isinstance(m, str) else m)) for m in model["merges"]]
        kind = self._json.get("pre_tokenizer") or {}
        if made != list(range(256, 256 + len(made))) or kind.get("type") != "ByteLevel" or not kind.get("use_regex", True) or kind.get("add_prefix_space") or self._json.get("normalizer"):
            return None
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={spelt[i]: i for i in range(256 + len(made))}, special_tokens={})

    def encode_a(self, texts: list[str]) -> list[np.ndarray]:
        return [self._one(" " + t) for t in texts]

    def _one(self, t: str) -> np.ndarray:
        if self.a_fast is not None and (t.isascii() or max(t) < "ɐ"):
            try:
                return self.a_fast.encode_to_numpy(t, disallowed_special=())
            except Exception:  # its regular expressions give up on very long runs of spaces
                pass
        return np.array(self.a_exact.encode(t, add_special_tokens=False).ids, np.int64)

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        return self.b_model.encode(texts, num_threads=1)


def tokenizers(path: str = TOKENIZERS, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> Tokenizers:
    """Both tokenizers, read on the driver from a folder; executors need no copy of the files."""
    files = []
    for name in (a, b):
        with open(f"{path}/{name}", "rb") as f:
            files.append(f.read())
    return Tokenizers(*files)


class Bitset:
    """Bits at some places, packed into 64-bit words, with running counts."""

    def __init__(self, places: np.ndarray, size: int) -> None:
        bits = np.zeros(-(-max(size, 1) // 64) * 64, bool)
        bits[places] = True
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        n = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(n) - n

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Bits up to and with each place."""
        word = places >> 6
        below = self.words[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (63 - (places & 63)).astype(np.uint64))
        return self.before[word] + np.bitwise_count(below).astype(np.int64)


def select(words: np.ndarray) -> np.ndarray:
    """Places of the bits, ascending."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def groups(a_ends: np.ndarray, b_ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes at which shared cuts end, and how many tokens of A and of B lie before each; ends are numbers of bytes."""
    a, b = Bitset(a_ends - 1, size), Bitset(b_ends - 1, size)
    at = select(a.words & b.words)
    return at + 1, a.rank(at), b.rank(at)


def expand(a: np.ndarray, b: np.ndarray, doc: np.ndarray, na: np.ndarray, nb: np.ndarray, size_b: int, space: int, limit: int = LINKS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct links as doc * space + a * size_b + b, ascending, and their numbers. na, nb, doc: of each group."""
    wide = np.repeat(nb, na)  # partners of each token of A
    first = np.repeat(np.cumsum(nb) - nb, na)
    key = np.repeat(doc, na) * space + a.astype(np.int64) * size_b
    done = np.cumsum(wide)
    keys, counts, i = [], [], 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + limit, "right")))
        w = wide[i:j]
        partner = np.arange(w.sum()) + np.repeat(first[i:j] - (np.cumsum(w) - w), w)
        k, n = np.unique(np.repeat(key[i:j], w) + b[partner], return_counts=True)
        keys.append(k)
        counts.append(n)
        i = j
    if len(keys) < 2:
        return (keys[0], counts[0]) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    k = np.concatenate(keys)
    order = np.argsort(k, kind="stable")
    k, n = k[order], np.concatenate(counts)[order]
    new = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[new], np.add.reduceat(n, new)


def _run(models: Tokenizers, column: pa.Array, names: list[str], limit: int = LINKS) -> dict[str, pa.Array]:
    """The new columns for a chunk of texts."""
    spell_a, spell_b = models.a_spelling, models.b_spelling
    raw = [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
    texts = [x.decode(errors="replace") for x in raw]
    some = [i for i, x in enumerate(texts) if x]
    ids_a, ids_b = models.encode_a([texts[i] for i in some]), models.encode_b([texts[i] for i in some])
    count_a, count_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
    a, b = (np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) for x in ids)]) for ids in (ids_a, ids_b))
    size = np.array([len(raw[i]) + 1 for i in some], np.int64)

    def fits(ids: np.ndarray, count: np.ndarray, spelling: Spelling, ok: np.ndarray) -> np.ndarray:
        spelt = np.bincount(np.repeat(np.arange(len(some)), count), spelling.length[ids], len(some)).astype(np.int64)
        ok = ok & (spelt == size)
        want = np.frombuffer(b"".join(b" " + raw[i] for i, k in zip(some, ok, strict=True) if k), np.uint8)
        same = spelling.spell(ids[np.repeat(ok, count)]) == want
        if not same.all():
            of = np.repeat(np.flatnonzero(ok), size[ok])
            ok[np.unique(of[~same])] = False
        return ok

    ok = fits(a, count_a, spell_a, fits(b, count_b, spell_b, np.ones(len(some), bool)))
    a, b, rows = a[np.repeat(ok, count_a)], b[np.repeat(ok, count_b)], np.array(some, np.int64)[ok]
    count_a, count_b, size = count_a[ok], count_b[ok], size[ok]
    total = int(size.sum())
    cuts, upto_a, upto_b = groups(np.cumsum(spell_a.length[a]), np.cumsum(spell_b.length[b]), total)
    na, nb = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
    last = np.searchsorted(cuts, np.cumsum(size))  # of each text, whose end is a cut
    n_groups = np.diff(last, prepend=-1)
    doc = np.repeat(np.arange(len(rows)), n_groups)
    n_links = np.bincount(doc, na * nb, len(rows)).astype(np.int64)
    # the groups as text: tokens in the order of groups, A's before B's, each with the mark that follows it
    size_a, size_b = len(spell_a.length), len(spell_b.length)
    marks = models.__dict__.setdefault("_marks", [f"{i}{m}" for i in range(size_a) for m in ",|"] + [f"{i}{m}" for i in range(size_b) for m in ",;"])
    codes = np.empty(len(a) + len(b), np.int64)
    at_a, at_b = np.arange(len(a)) + np.repeat(upto_b - nb, na), np.arange(len(b)) + np.repeat(upto_a, nb)
    codes[at_a], codes[at_b] = 2 * a, 2 * (size_a + b)
    codes[at_a[upto_a - 1]] += 1
    codes[at_b[upto_b - 1]] += 1
    bounds = np.concatenate(([0], np.cumsum(count_a + count_b))).tolist()
    listed, get = codes.tolist(), marks.__getitem__
    keys, times = expand(a, b, doc, na, nb, size_b, size_a * size_b, limit)
    of, pairs = np.divmod(keys, size_a * size_b)
    n = len(column)

    def spread(values: np.ndarray) -> pa.Array:
        out = np.zeros(n, np.int64)
        out[rows] = values
        return tx.int64s(out)

    text = [""] * n
    for i, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        text[rows[i]] = "".join(map(get, listed[x:y]))[:-1]
    held = np.zeros(n + 1, np.int64)
    held[rows + 1] = np.bincount(of, minlength=len(rows))
    offsets = pa.array(np.cumsum(held), pa.int32())
    made = (spread(count_a), spread(count_b), spread(n_groups), spread(n_links), pa.array(text, pa.string()), pa.ListArray.from_arrays(offsets, tx.int64s(pairs)), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32())))
    return dict(zip(names, made, strict=True))


def align(docs: DataFrame, models: Tokenizers | None = None, text_col: str = "text", limit: int = LINKS) -> DataFrame:
    """``docs`` with n_a, n_b (tokens), n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``: ids of A and B of each group, in
    order), pairs (distinct linked ids as a * size of B's vocabulary + b, ascending) and times (links of each)."""
    models = tokenizers() if models is None else models
    shared = docs.sparkSession.sparkContext.broadcast(models)  # the two files, a few MB
    schema = tx.extended(docs, COLUMNS)
    where, new = docs.columns.index(text_col), schema.names[len(docs.columns) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, first = batch.column(where), 0
            upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            while first < len(column):
                end = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + tx.CHUNK, "right")))
                part = batch.slice(first, end - first)
                made = _run(shared.value, part.column(where), new, limit)
                yield pa.RecordBatch.from_arrays([*part.columns, *made.values()], names=schema.names)
                first = end

    return docs.mapInArrow(run, schema)


def pair_counts(pairs: DataFrame, size_b: int) -> DataFrame:
    """(pair, docs, best): in how many documents a pair is linked, and whether no other pair of its A id is in more.

    pairs: rows with an array ``pairs`` of distinct pairs each.
    """
    counts = cut(pairs.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs")))
    a = F.expr(f"pair div {size_b}")
    top = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))
    return counts.withColumn("a", a).join(top, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def links(aligned: DataFrame, size_b: int, rows: int = 4_000_000) -> DataFrame:
    """``aligned``, a written table with a row number ``row``, pairs and times, with n_best (links whose pair is best for
    its A id) and count_sum (documents of the pair, summed over links) in place of pairs and times."""
    counts = small(cut(pair_counts(aligned, size_b)), rows)
    single = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = single.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("docs") * F.col("times")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return aligned.drop("pairs", "times").join(sums, "row", "left").withColumns({c: F.coalesce(c, zero) for c in ("n_best", "count_sum")})


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    models = tokenizers()
    aligned = align(docs, models)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    kept = cut(aligned.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "pairs", "times"))
    return links(kept, len(models.b_spelling.length)).drop("row")


QUERIES = {"op13_alignment": op13_alignment}
