import re

from pyspark.sql import functions as F

from millrace.llm import decontaminate as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def brute(docs, items, window):
    windows = {}
    for i, text in items:
        w = words(text)
        if i is None or not w:
            continue
        for k in range(max(1, len(w) - window + 1)):
            windows.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if (key := tuple(w[k : k + size])) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[key]
        out[doc] = (len(w), len(hit), sorted(found))
    return out


def test_against_brute_force_on_tables(spark):
    base = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{base}/benchmark.parquet")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in d.find_contamination(docs, bench).collect()}
    want = brute([tuple(r) for r in docs.collect()], [tuple(r) for r in bench.collect()], 13)
    assert got == want
    assert sum(v[1] > 0 for v in want.values()) > 5


def test_odd_cases_and_small_windows(spark):
    docs = [(1, None), (2, ""), (3, "a b c a b c a b"), (4, "É x-É_x a"), (5, "c A;b!c"), (6, "a b c " * 5000), (6, "c"), (None, "a b")]
    items = [(1, "a b c"), (2, "c"), (3, None), (3, "b c a b c d"), (None, "x"), (4, "é"), (5, "x É X a"), (6, "A b")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for window in (1, 2, 3, 13):
        got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in d.find_contamination(frame, bench, window=window).collect()]
        want = [(i, *brute([(i, t)], items, window)[i]) for i, t in docs]
        assert sorted(got, key=str) == sorted(want, key=str), window


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in d.find_contamination(docs, none).collect()] == [0]
    assert d.find_contamination(docs.limit(0), none).count() == 0
    assert d.remove_contaminated(docs, docs.select(F.col("doc_id").alias("item_id"), "text")).count() == 0


def test_query_matches_its_sql(spark):
    import duckdb

    base, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS FROM '{base}/{t}.parquet'")
    assert {tuple(r) for r in d.op6_decontaminate(spark, base).collect()} == set(con.sql(d.OP6_SQL).fetchall())


def test_spans_are_cut_by_length_and_coverage(spark):
    item = " ".join(f"item{i}" for i in range(20))
    long = " ".join(f"w{i}" for i in range(1000))
    docs = spark.createDataFrame([(1, f"before, {item}! after"), (2, f"{long} {item} {long}"), (3, None), (4, "nothing"), (5, f"{long} " + " ".join(item.split()[:13]))], "doc_id long, text string").withColumn("spans", F.lit("x"))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.text for r in d.remove_spans(docs, bench, longest=15).collect()}
    assert got == {1: "before, ! after", 2: f"{long}  {long}", 3: None, 4: "nothing", 5: f"{long} " + " ".join(item.split()[:13])}
    assert d.remove_spans(docs, bench).where("doc_id = 5").first().text == f"{long} "
    kept = d.remove_contaminated(docs.withColumn("n_words", F.lit(0)), bench)
    assert kept.columns == ["doc_id", "text", "spans", "n_words"] and {r.doc_id for r in kept.collect()} == {2, 3, 4, 5}
    assert d.remove_spans(docs.limit(0), bench).count() == 0
