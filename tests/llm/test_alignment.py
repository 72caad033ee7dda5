"""Aligned tokens against a plain version: both tokenizers asked directly, ends compared as sets, links listed one by one."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import alignment as al

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(f"{al.TOKENIZERS}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{al.TOKENIZERS}/piece_bpe_32k.model")
    letters = al.byte_letters()

    def groups(text):
        if not text:
            return []
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        spelt_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        spelt_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        if not b"".join(spelt_a) == b"".join(spelt_b) == (" " + text).encode():
            return []
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in (spelt_a, spelt_b)]
        out, x, y = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            x2, y2 = ends[0].index(cut, x) + 1, ends[1].index(cut, y) + 1
            out.append((ids_a[x:x2], ids_b[y:y2]))
            x, y = x2, y2
        return out

    return groups


def brute(rows, plain):
    found = [(i, plain(t)) for i, t in rows]
    links = [[(x, y) for a, b in g for x in a for y in b] for _, g in found]
    docs = Counter(p for ls in links for p in set(ls))
    most = {}
    for (x, _), n in docs.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for (i, g), ls in zip(found, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(ls), sum(docs[p] == most[p[0]] for p in ls), sum(docs[p] for p in ls), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    (1, None), (2, ""), (3, " "), (4, "plain words, plainly said"), (4, "plain words, plainly said"), (None, "plain"), (5, "  two  spaces\n\n\ttabs  "), (6, "<|endoftext|> and <s> </s> <unk> <0x41>"),
    (7, "a▁b"), (8, "日本語のテキストとemoji 👩‍👩‍👧 \U0001f600"), (9, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40), (10, "ﬁne ﬂuﬀ İstanbul ſtraße  \u0085  x"), (11, "don't we'll they're 1234567 ²³¼ 'S"),
    (12, "\x00\x01 nul"), (13, "é combining"), (14, "-" * 999 + "=" * 1001 + " " * 777), (15, "x" * 30000), (16, "été où ça Übergröße ñandú " * 900),
]


def got(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=str)


def test_whole_table(spark, plain):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(al.op13_alignment(spark, SF)) == brute(rows, plain)


def run(spark, docs, tmp_path, rows=4_000_000, limit=al.LINKS):
    models = al.tokenizers()
    out = al.align(docs, models, limit=limit)
    kept = out.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", "n_links", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"), "pairs", "times")
    kept.write.parquet(str(tmp_path / "kept"))
    return al.links(spark.read.parquet(str(tmp_path / "kept")), len(models.b_spelling.length), rows)


@pytest.mark.parametrize("rows,limit", [(4_000_000, al.LINKS), (0, 7)])  # broadcast and shuffle; one step and many
def test_odd_texts(spark, plain, tmp_path, rows, limit):
    assert got(run(spark, spark.createDataFrame(ODD, "doc_id long, text string"), tmp_path, rows, limit)) == brute(ODD, plain)


def test_empty_table_and_clashing_names(spark, tmp_path):
    assert got(run(spark, spark.createDataFrame([], "doc_id long, text string"), tmp_path)) == []
    one = al.align(spark.createDataFrame([(1, "some text", "mine")], "doc_id long, text string, groups string")).first()
    assert one.groups == "mine" and one.groups_ and one.n_a > 0


def test_invalid_utf8_has_no_tokens(spark):
    one = al.align(spark.sql("SELECT 1L AS doc_id, cast(unhex('41FF42') AS string) AS text")).first()
    assert (one.n_a, one.groups, one.pairs) == (0, "", [])


def test_fast_encoder_agrees_on_every_character_it_is_used_for():
    models = al.tokenizers()
    assert models.a_fast is not None
    for c in map(chr, range(0x250)):
        for t in (f" {c}", f" a{c}b", f" a {c}{c} 1{c}2 ", f"{c}'s {c} \n{c}", f" .{c}.  {c}  \t{c}"):
            assert models._one(t).tolist() == models.a_exact.encode(t, add_special_tokens=False).ids, (t, c)


def test_rank_and_select():
    rng = np.random.default_rng(3)
    for size in (1, 63, 64, 65, 1000):
        places = np.flatnonzero(rng.random(size) < 0.3)
        bits = al.Bitset(places, size)
        assert al.select(bits.words).tolist() == places.tolist()
        every = np.arange(size)
        assert bits.rank(every).tolist() == [int((places <= i).sum()) for i in every]


def test_groups_that_never_meet():
    a, b = np.repeat(np.arange(50), 4), np.repeat(np.arange(40), 5)
    keys, times = al.expand(a, b, np.array([0]), np.array([200]), np.array([200]), 100, 10_000, limit=300)
    assert len(keys) == 2000 and (times == 20).all()
