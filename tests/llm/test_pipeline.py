from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import language
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_neardup import brute as groups

BASE = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    # what stage 1 rejects is taken from its operator, whose models have a brute-force test of their own
    models = language.calibrated(docs.where(~language.held_out()))
    known = {r.doc_id for r in language.identify(docs.select("doc_id", "text"), models).where("not rejected").collect()}
    assert len(known) >= 0.98 * len(rows)
    rows = {i: t for i, t in rows.items() if i in known}
    step = groups(list(rows.items()), 5, 80)
    kept = {i: t for i, t in rows.items() if step[i][2]}
    items = [tuple(r) for r in spark.read.parquet(f"{BASE}/benchmark.parquet").select("item_id", "text").collect()]
    hit = contaminated(list(kept.items()), items, 13)
    kept = {i: t for i, t in kept.items() if not (hit[i][1] > 0 and 20 * hit[i][1] >= hit[i][0])}
    out = corpus_pipeline.run(spark, BASE)
    assert out.columns == [*docs.columns, "shard", "slot"]
    got = out.collect()
    times = Counter(r.doc_id for r in got)
    assert set(times) <= set(kept) and max(times.values()) <= 3
    assert all(r.text == rows[r.doc_id] for r in got)
    words = lambda ids: sum(len(rows[i].split()) for i in ids)
    assert abs(words(r.doc_id for r in got) - words(kept)) < 0.1 * words(kept)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len({(r.doc_id, r.shard) for r in got}) == len(times)


def test_stages_take_odd_rows_and_clashing_names(spark, tmp_path):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    names = ["rejected", "score", "n_words", "n_hit", "spans", "limit", "row", "k", "gone", "shard"]
    odd = docs.limit(1).unionByName(docs.limit(1)).unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType)))
    odd = odd.unionByName(docs.limit(2).withColumns({c: F.lit(None).cast("string") for c in ("text", "source", "lang")}))
    odd = odd.unionByName(docs.limit(1).withColumn("text", F.repeat(F.lit("a long text of many words. "), F.lit(20_000)))).unionByName(docs.limit(1).withColumn("text", F.lit("")))
    docs = docs.unionByName(odd).withColumns({c: F.lit("clash") for c in names})
    for kind, now in (("some", docs), ("none", docs.limit(0))):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, now, BASE).write.parquet(f"{tmp_path}/{name}-{kind}")
            now = spark.read.parquet(f"{tmp_path}/{name}-{kind}")
            assert k == 4 or now.columns == docs.columns, name
        assert now.columns == [*docs.columns, "shard_", "slot"] and now.isEmpty() == (kind == "none")
