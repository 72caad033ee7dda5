"""License passages in documents, by diagonal voting.

Every rolling run of words of a text (pairs for the short templates, runs of ``K`` words for the long ones) is hashed and
joined to the positions of the same run in the templates. A match at word i of the text and word j of a template is a vote
for the diagonal i - j, and votes add up by (row, template, diagonal). Neighbouring diagonals, which a word more or less in
the text gives, merge: each diagonal opens a span that reaches over the next ``NEAR`` ones, so that a chain of many near
diagonals gives overlapping spans, not one that is too long. Each span is then verified:

* phrases of the base list stand where one diagonal has all their runs;
* any other template stands where one diagonal has all its runs, or in a span that has ``COVER`` of the template's *distinct*
  runs and whose words are near the template's by word edit distance, with the words that tell licenses apart (``TELLING``)
  the template's in order.

All of it is DataFrame functions. Templates are a fixed list, so the joined side has a known size.

Defined cases: null and empty texts have no words, no labels and score 0; every row counts by itself, also where doc_id is
null or repeated; rows are told apart by doc_id and text, so equal rows have equal results; texts of any length are scanned
whole; nulls elsewhere and extra columns do not matter.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.checkpoints import cut, small

# Phrases that must be found word for word.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# The words of well-known license texts and notices, with the label each stands for.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by 4 0": "cc-by-4.0",
    "released under the mit license": "mit-notice",
    "all rights reserved": "all-rights-reserved",
    "subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "dedicated to the public domain under cc0": "cc0",
}
# Texts of licenses as their publishers give them.
TEXTS = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License.""",
    "gpl-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
        the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details.""",
    "lgpl-notice": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
        General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your
        option) any later version.""",
    "mpl-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions.""",
    "boost": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
        transmit the Software, and to prepare derivative works of the Software.""",
}
#: Words of a run of the long templates; the short ones have pairs.
K = 4
#: Share of a template's runs that a span must have.
COVER = 0.8
#: Diagonals that a span may reach over: a few words more or less within it.
NEAR = 4
#: Words that tell one license from another; a minor version 0 may be left out.
TELLING = "^(cc|cc0|nc|sa|nd|apache|mit|bsd|mozilla|lesser|library|affero|gpl|lgpl|agpl|[1-9][0-9]?)$"
_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def template_rows() -> list[tuple[int, list[str], str, bool, int]]:
    """(template, words, label, exact, words of a run)."""
    long = [(re.findall("[a-z0-9]+", t.lower()), label, False, K) for label, t in TEXTS.items()]
    short = [(t.split(" "), label, exact, 2) for exact, group in ((True, BASE), (False, TEMPLATES)) for t, label in group.items()]
    return [(i, *x) for i, x in enumerate(short + long)]


def template_runs(spark) -> DataFrame:
    """(run, template, at, runs, k, label, exact): each rolling run of each template."""
    rows = spark.createDataFrame(template_rows(), "template int, t array<string>, label string, exact boolean, k int").withColumn("runs", F.size("t") - F.col("k") + 1)
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)))
    run = lambda k: F.xxhash64(F.lit(k), *(F.get("t", F.col("at") + j) for j in range(k)))
    return rows.select(F.when(F.col("k") == 2, run(2)).otherwise(run(K)).alias("run"), "template", "at", "runs", "k", "label", "exact")


def words(column):
    """Words of the class that drops ASCII punctuation; lower-casing letters beyond ASCII changes neither their number nor
    any phrase, as no phrase has a letter that only such a letter maps to."""
    return F.array_remove(F.split(F.lower(F.coalesce(column, F.lit(""))), _SEPARATORS), "")


def votes(texts: DataFrame) -> DataFrame:
    """(row, template, runs, k, label, exact, i, at) of texts (row, w): the run at word i is the template's at word ``at``.
    Equal rows vote once."""
    shifted = F.arrays_zip(*(F.slice("w", j + 1, F.greatest(F.size("w"), F.lit(1))).alias(f"w{j}") for j in range(K)))
    pieces = texts.select("row", F.posexplode(shifted).alias("i", "p"))
    run = lambda k: F.when(F.col(f"p.w{k - 1}").isNotNull(), F.xxhash64(F.lit(k), *(F.col(f"p.w{j}") for j in range(k))))
    pieces = pieces.select("row", "i", F.explode(F.array(run(2), run(K))).alias("run"))
    return pieces.join(F.broadcast(template_runs(texts.sparkSession)), "run").drop("run").distinct()  # the runs of a fixed list


def verified(doubtful: DataFrame, texts: DataFrame) -> DataFrame:
    """Spans (row, template, left, right, ...) whose words are those of their template but for a few."""
    rows = [(i, t) for i, t, *_ in template_rows()]
    phrases = doubtful.sparkSession.createDataFrame(rows, "template int, t array<string>")
    both = texts.join(small(doubtful), "row").join(F.broadcast(phrases), "template")
    from_word = F.greatest(F.col("left"), F.lit(0))
    both = both.withColumn("w", F.slice("w", from_word + 1, F.greatest(F.col("right") - from_word + 1, F.lit(0))))
    code = lambda c: F.array_join(F.transform(c, lambda x: F.char(F.array_position(F.array_distinct("t"), x) + 64)), "")
    telling = lambda c: F.filter(c, lambda x: x.rlike(TELLING))
    # each break costs a run's length of runs at least, and has up to two words more or less
    most = 2 * F.floor((1 - COVER) * F.col("runs") + 1e-9)
    return both.where((F.levenshtein(code("w"), code("t")) <= most) & (telling("w") == telling("t"))).drop("w", "t")


def spans(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (row, key, n_words) of the texts, and (row, label, exact, start, end, votes, runs) of the spans that stand."""
    row = F.struct(F.xxhash64(F.col(key), F.col(text_col)).alias("a"), F.hash(F.col(text_col), F.col(key)).alias("b"))
    texts = docs.select(row.alias("row"), F.col(key), words(F.col(text_col)).alias("w"))
    counted = texts.select("row", key, F.size("w").cast("long").alias("n_words"))
    found = votes(texts.select("row", "w")).withColumn("diagonal", F.col("i") - F.col("at"))
    found = cut(found.groupBy("row", "template", "label", "exact", "runs", "k", "diagonal").agg(F.count("*").alias("votes"), F.min("i").alias("first"), F.max("i").alias("last"), F.collect_set("at").alias("places")))
    size = F.col("runs") + F.col("k") - 1
    columns = ("row", "label", "exact", "start", "end", "votes", "runs")
    whole = found.where("votes = runs").select("row", "label", "exact", F.col("diagonal").alias("start"), (F.col("diagonal") + size).alias("end"), "votes", "runs")
    # neighbours merge: what each diagonal and the few after it have of the template, by distinct positions
    near = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(0, NEAR)
    loose = found.where("not exact").withColumns({
        "have": F.size(F.array_distinct(F.flatten(F.collect_list("places").over(near)))), "best": F.max("votes").over(near),
        "start": F.min("first").over(near), "end": F.max("last").over(near) + F.col("k"),
        "left": F.min(F.struct("first", "diagonal")).over(near)["diagonal"], "right": F.max(F.struct("last", "diagonal")).over(near)["diagonal"] + size - 1})
    doubtful = cut(loose.where((F.col("have") >= COVER * F.col("runs")) & (F.col("best") < F.col("runs"))).drop("places", "votes").withColumnRenamed("have", "votes"))
    return counted, whole.union(verified(doubtful, texts.select("row", "w")).select(*columns)).distinct()


def license_scan(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: key, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans."""
    counted, stand = spans(docs, key, text_col)
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    exact = F.col("exact")
    found = stand.groupBy("row").agg(
        F.count_if(exact).alias("n_base"), F.min(F.when(exact, F.col("start"))).alias("first_word"), F.max(F.when(exact, F.col("start"))).alias("last_word"),
        labels(F.when(exact, F.col("label"))).alias("base_labels"), labels("label").alias("labels"),
        F.max(F.least(F.lit(1.0), F.col("votes") / F.col("runs"))).alias("score"), F.count_distinct("label", "start").alias("n_spans"))
    out = counted.join(found, "row", "left")
    return out.select(
        key, "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"))


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op2_licenses": op2_licenses}
