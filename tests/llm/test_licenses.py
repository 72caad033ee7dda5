import random
import re

from pyspark.sql import functions as F

from millrace.llm import licenses as lic

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def base(text):
    w, found = words(text), []
    for phrase, label in lic.BASE.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(text):
    """(labels, score) by a scan of every template over every diagonal."""
    w, stand = words(text.lower() if text else text), {}
    for _, t, label, exact, k in lic.template_rows():
        runs = len(t) - k + 1
        hits = [(i, at) for i in range(len(w) - k + 1) for at in range(runs) if w[i : i + k] == t[at : at + k]]
        for d in {i - at for i, at in hits}:
            reach = [(i, at) for i, at in hits if d <= i - at <= d + lic.NEAR]
            have = len({at for _, at in reach})
            score = have / runs
            if w[max(d, 0) : d + len(t)] != t:
                if exact or have < lic.COVER * runs:
                    continue
                # a diagonal in reach that has all is found by itself
                if any(sum(i - at == x for i, at in reach) == runs for x in range(d, d + lic.NEAR + 1)):
                    continue
                first = {x: min(i for i, at in reach if i - at == x) for x in {i - at for i, at in reach}}
                last = {x: max(i for i, at in reach if i - at == x) for x in first}
                left = min((i, x) for x, i in first.items())[1]
                right = max((i, x) for x, i in last.items())[1] + len(t)
                part, most = w[max(left, 0) : right], 2 * int((1 - lic.COVER) * runs + 1e-9)
                telling = lambda c: [x for x in c if re.search(lic.TELLING, x)]
                if edits(part, t) > most or telling(part) != telling(t):
                    continue
            stand[label] = max(stand.get(label, 0), score if w[max(d, 0) : d + len(t)] != t else 1.0)
    return ",".join(sorted(stand)), max(stand.values(), default=0.0)


def test_query_against_a_scan_of_all_diagonals(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in lic.op2_licenses(spark, "/root/testdata/sf0.01").collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for d in rows:
        r = got[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(d.text)
        if r.labels or re.search("(?i)licen|rights|permission|redistrib|cc0", d.text or ""):
            labels, score = brute(d.text)
            assert (r.labels, round(r.score, 9)) == (labels, round(score, 9)), d.doc_id
        else:
            assert r.score == 0
    assert sum(r.n_base > 0 for r in got.values()) > 5


def test_edited_license_texts_against_the_scan(spark):
    rng, rows = random.Random(4), []
    for label, text in {**lic.TEXTS, **{v: k for k, v in lic.TEMPLATES.items()}}.items():
        for n in (0, 1, 2, 3, 6):
            w = text.split()
            for _ in range(n):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = rng.choice([[], ["very"], ["one", "more"]])
            around = [" ".join(rng.choice(["of the", "software", "license", "x", "permission is", "all rights"]) for _ in range(rng.randint(0, 30))) for _ in range(2)]
            rows.append((label, n, f"{around[0]}\n{' '.join(w)}. {around[1]}"))
    docs = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in lic.license_scan(docs).collect()}
    for i, (label, n, text) in enumerate(rows):
        want = brute(text)
        assert got[i] == (want[0], round(want[1], 9)), text
        if n == 0:
            assert label in got[i][0].split(",")
    assert sum(label in got[i][0].split(",") for i, (label, n, _) in enumerate(rows) if n == 1) >= 13


def test_labels_are_neither_invented_nor_lost_in_chains(spark):
    apache = "licensed under the apache license version 2 0"
    texts = {"all rights all rights": "", "licensed under " * 5 + apache: "apache,apache-2.0", f"{apache} " * 40: "apache,apache-2.0", "reserved rights all": "", "rights reserved all rights reserved": "all-rights-reserved"}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {list(texts)[r.doc_id]: r.labels for r in lic.license_scan(docs).collect()} == texts


def test_odd_rows(spark):
    texts = [
        "The MIT-License and mit license; general PUBLIC license, general public apache license", None, "", "mit", "İstanbul mıt license MİT license K",
        "Licensed under the very Apache License, Version 2.0", "licensed under cc by", "x " * 30000 + "mit license", "mit license " * 5000,
        "all all rights reserved rights reserved", "license mit\x00license",
    ]
    frame = spark.createDataFrame([(i // 2 if i else None, t) for i, t in enumerate(texts + texts[:3])], "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("w", F.lit(1))
    got = sorted(tuple(str(x) for x in r[:6]) for r in lic.license_scan(frame).collect())
    assert got == sorted(tuple(str(x) for x in (i // 2 if i else None, *base(t))) for i, t in enumerate(texts + texts[:3]))
    assert lic.license_scan(frame.limit(0)).count() == 0


def test_spans_are_verified_against_the_words_of_their_template(spark):
    gpl = "This work is licensed under the GNU General Public License version"
    want = {
        "Licensed under CC BY-SA 4.0": "cc-by-sa-4.0", "Licensed under CC BY-NC 4.0": "cc-by-nc-4.0", "Licensed under CC BY 4.0": "cc-by-4.0",
        "Licensed under CC BY-ND 4.0": "", "Licensed under CC BY-NC-SA 4.0": "", "licensed under licensed under cc by 4 0": "cc-by-4.0", "licensed under the cc by 4 0": "cc-by-4.0",
        "Licensed under the terms of Apache License, Version 2.0": "apache,apache-2.0", "Licensed under the Apache License, Version 2": "apache,apache-2.0",
        "Licensed under the Apache License, Version 2.1": "apache",
        f"{gpl} 3": "gpl,gpl-3.0", f"{gpl} 2": "gpl", gpl.replace("GNU", "GNU Lesser") + " 3": "gpl", gpl.replace("GNU", "GNU Affero") + " 3": "gpl",
        gpl.replace("work", "fine work") + " 3 or later": "gpl,gpl-3.0",
    }
    docs = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in lic.license_scan(docs).collect()}
    assert {t: got[i] for i, t in enumerate(want)} == want
