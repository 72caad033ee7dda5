"""Operators on the fixtures: stated and hand-derived results, and edge semantics."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.functions.expressions import ExpressionError, evaluate
from millrace.functions.templates import TemplateError, render_template
from millrace.operators import access_map, fuzzy, graph, intervals, outliers, sales, strings, timeseries, upsert
from millrace.streaming.lru import replay


ROLE_EDGES = [("FARMERS_MASTER1", "CHILD1"), ("FARMERS_MASTER1", "CHILD10"), ("FARMERS_MASTER2", "CHILD10"), ("CHILD1", "CHILD2"), ("CHILD2", "CHILD3"), ("CHILD2", "CHILD4"), ("CHILD10", "CHILD5")]
GRANTS = [("CHILD3", "DB1", "SCH1", "USAGE"), ("CHILD3", "DB1", "SCH1", "SELECT"), ("CHILD4", "DB2", "SCH2", "USAGE"), ("CHILD5", "DB1", "SCH1", "USAGE"), ("CHILD5", "DB3", "SCH3", "SELECT")]
WAREHOUSES = [("CHILD3", "WH_A", "USAGE"), ("CHILD3", "WH_A", "OPERATE"), ("CHILD5", "WH_B", "USAGE"), ("CHILD10", "WH_A", "USAGE")]


def inline(spark, rows, names):
    return spark.createDataFrame(rows, ", ".join(f"{n.strip()} string" for n in names.split(",")))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text,context,want", [
    ("2 + 3 * 4", {}, 14), ("(2 + 3) * 4", {}, 20), ("2 ** 3 ** 2", {}, 512), ("-3 ** 2", {}, 9), ("abs(-7) + sqrt(9)", {}, 10.0), ("pow(2, 10) ", {}, 1024),
    ("x ** 2 + 4 * x - 3", {"x": 5}, 42), ("a + b * c - d / 2", {"a": 1, "b": 2, "c": 3, "d": 8}, 3.0), ("10 + max(1, 2)", {}, 12), ("3 + round(2.5)", {}, 5),
    ("-7 % 3", {}, 2), ("7 % -3", {}, -2), ("min(4, 2, 9) - -1", {}, 3), ("round(2.675, 1)", {}, 2.7), ("2 ** -1", {}, 0.5),
])
def test_expressions(spark, text, context, want):
    assert one(spark, evaluate(text, context)) == pytest.approx(want)


@pytest.mark.parametrize("text", ["", "1 +", "(1", "1 2", "foo(1)", "pow(1)", "y", "1e5x", "+1", "round(1, x)", "$"])
def test_bad_expressions(text):
    with pytest.raises(ExpressionError):
        evaluate(text, {"x": 1})


def test_templates(spark):
    df = spark.sql("""SELECT named_struct('name', "o'neil mac-donald", 'tier', 'gold') AS user, array(named_struct('name', 'pen', 'price', 2), named_struct('name', 'ink & co', 'price', 3)) AS cart,
        cast(null as string) AS note, '<b>x</b>' AS banner, map('k', 'v') AS m, array('a', 'b') AS tags, true AS yes, cast(array() as array<string>) AS none""")
    cases = {
        "{{ user.name | title }}": "O&#x27;Neil Mac-Donald", "{% if user.tier == 'gold' %}G{% else %}S{% endif %}": "G",
        "{% for i in cart %}{{ loop.index }}{{ loop.index1 }}:{{ i.name }}{% if loop.last %}.{% else %},{% endif %}{% endfor %}": "01:pen,12:ink &amp; co.",
        "{{ cart | len }}{{ note | default:'none' }}{{ banner | safe }}{{ banner | safe | upper }}": "2none<b>x</b>&lt;B&gt;X&lt;/B&gt;",
        "{{ missing }}{# gone #}{% for x in missing %}y{% endfor %}{{ m.k }}{{ tags | join:'-' }}{{ yes }}": "va-bTrue",
        "{% if none %}a{% endif %}{% if tags %}b{% endif %}{% if note %}c{% endif %}{% if missing != 1 %}d{% endif %}": "bd",
        "{% for t in tags %}{% for i in cart %}{{ t }}{{ i.price }} {% endfor %}{% endfor %}": "a2 a3 b2 b3 ",
    }
    for source, want in cases.items():
        assert df.select(render_template(source, df).alias("x")).first().x == want, source
    for bad in ("{% if a %}", "{% for x in y %}", "{% elif %}", "{{ a | nope }}", "{% for x %}{% endfor %}"):
        with pytest.raises(TemplateError):
            render_template(bad, df)


def test_longest_unique_and_windows(spark):
    rows = [("abcabcbb", 3), ("bbbbb", 1), ("pwwkew", 3), ("", 0), (" ", 1), ("dvdf", 3), ("abba", 2)]
    got = {r.s: r.m for r in spark.createDataFrame(rows, "s string, n int").withColumn("m", strings.longest_unique_substring(F.col("s"))).collect()}
    assert all(got[s].length == n and got[s].content == s[got[s].start : got[s].start + n] for s, n in rows)
    s = F.lit("abcabcbb_pwwkew_eceba_aabbccdd")
    m = one(spark, strings.longest_unique_substring(s))
    assert (m.content, m.start, m.end) == ("ceba_", 17, 21)
    assert [(w.start, w.end) for w in one(spark, strings.all_unique_windows(s, 3))] == [(0, 2), (1, 3), (2, 4), (3, 5), (7, 10), (11, 13), (12, 15), (14, 17), (17, 21)]
    assert [one(spark, strings.longest_with_k_distinct(s, k)).content for k in (1, 2, 3)] == ["bb", "bcbb", "abcabcbb"]
    assert one(spark, strings.highlight(F.lit("abcd"), strings.longest_unique_substring(F.lit("abcd")), "*")) == "*abcd*"


def test_anagrams(spark):
    words = ["listen", "silent", "enlist", "tinsel", "Dormitory", "dirty room", "evil", "vile", "x", ""]
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    got = [r.words for r in strings.group_anagrams(frame).collect()]
    assert got == [["enlist", "listen", "silent", "tinsel"], ["Dormitory", "dirty room"], ["evil", "vile"]]
    summary = strings.anagram_summary(strings.group_anagrams(frame)).first()
    assert (summary.groups, summary.words, summary.largest, summary.average) == (3, 8, 4, 2.67)
    simple = strings.group_anagrams(frame, case_insensitive=False, letters_only=False, min_group_size=1)
    assert simple.count() == 6 and simple.where("n = 1").count() == 4


def test_spelling(spark):
    pairs = [("helo", "help", 0.5), ("helo", "hello", 1.0), ("xelo", "hello", 2.0), ("", "abc", 3.0), ("abc", "", 3.0), ("ABC", "abc", 0.0), ("kitten", "sitting", 3.0)]
    frame = spark.createDataFrame(pairs, "a string, b string, d double").withColumn("got", fuzzy.weighted_distance(F.col("a"), F.col("b")))
    assert all(r.got == r.d for r in frame.collect()), frame.collect()
    assert len(fuzzy.key_neighbours()) == 106
    words = spark.createDataFrame([("hello", 5), ("help", 9), ("held", 1), ("world", 7)], "word string, frequency int")
    got = [(r.word, r.suggestion, r.distance) for r in fuzzy.suggest(spark.createDataFrame([("helo",), ("world",), (None,)], "word string"), words, k=2).orderBy("word", "place").collect()]
    assert got == [("helo", "help", 0.5), ("helo", "hello", 1.0), ("world", "world", 0.0)]


def test_fuzzy_join(spark):
    left = spark.createDataFrame([("L1", "Acme Inc."), ("L2", "Café Noir GmbH"), ("L3", "Globex"), ("L4", "Unknown Thing"), ("L5", None)], "left_id string, name string")
    right = spark.createDataFrame([("R1", "ACME Corporation"), ("R2", "cafe noir gmbh"), ("R3", "Globexx"), ("R4", "Nobody")], "right_id string, name string")
    got = {(r.left_id, r.right_id): (r.score, r.status) for r in fuzzy.fuzzy_join(left, right).collect()}
    assert got[("L1", "R1")] == (1.0, "matched")
    assert got[("L2", "R2")][1] == "matched" and got[("L3", None)] == (0.5, "left_only")  # a fuzzy match of one token over a union of two
    assert got[("L4", None)] == (0.0, "left_only") and got[("L5", None)] == (0.0, "left_only")
    assert got[(None, "R3")][1] == got[(None, "R4")][1] == "right_only" and len(got) == 7


def test_access_map_golden(spark):
    edges, grants = inline(spark, ROLE_EDGES, "parent, child"), inline(spark, GRANTS, "role, database, schema, privilege")
    out = access_map.nested_record(access_map.build_access_map(edges, grants, shape="children")).collect()
    records = sorted((json.loads(r.record) for r in out), key=lambda r: (r["master_role"], r["database"]))
    assert len(records) == 5
    first = records[0]
    assert (first["master_role"], first["database"], first["schema"], first["permissions"]) == ("FARMERS_MASTER1", "DB1", "SCH1", ["SELECT", "USAGE"])
    assert first["children"] == [
        {"role": "CHILD5", "level": 2, "path": ["FARMERS_MASTER1", "CHILD10", "CHILD5"], "privileges": ["USAGE"]},
        {"role": "CHILD3", "level": 3, "path": ["FARMERS_MASTER1", "CHILD1", "CHILD2", "CHILD3"], "privileges": ["SELECT", "USAGE"]}]


def test_catalog_grants(spark):
    grants = [("USAGE", "ROLE", "ROLE1", "MASTERROLE1"), ("USAGE", "ROLE", "ROLE2", "MASTERROLE1"), ("USAGE", "ROLE", "ROLE3", "ROLE1"), ("USAGE", "ROLE", "ROLE3", "MASTERROLE2"),
              ("USAGE", "SCHEMA", "DB1.SCHEMA", "ROLE1"), ("USAGE", "SCHEMA", "DB2.SCHEMA", "ROLE2"), ("USAGE", "DATABASE", "DB1", "ROLE3")]
    cat = spark.createDataFrame(grants, "PRIVILEGE string, GRANTED_ON string, NAME string, GRANTEE_NAME string").withColumns({"GRANTED_TO": F.lit("ROLE"), "DELETED_ON": F.lit(None).cast("timestamp"), "TABLE_CATALOG": F.lit(None).cast("string"), "TABLE_SCHEMA": F.lit(None).cast("string")})
    edges = access_map.role_edges(cat)
    rows = access_map.path_rows(graph.simple_paths(edges, graph.top_roots(edges)), access_map.object_grants(cat, split_names=True))
    assert {(r.root, tuple(r.path), r.database, r.schema) for r in rows.collect()} == {
        ("MASTERROLE1", ("MASTERROLE1", "ROLE1"), "DB1", "SCHEMA"), ("MASTERROLE1", ("MASTERROLE1", "ROLE2"), "DB2", "SCHEMA"),
        ("MASTERROLE1", ("MASTERROLE1", "ROLE1", "ROLE3"), "DB1", None), ("MASTERROLE2", ("MASTERROLE2", "ROLE3"), "DB1", None)}
    assert access_map.object_grants(cat).count() == 0
    users = spark.createDataFrame([("U1",), ("U2",)], "NAME string").withColumn("DELETED_ON", F.lit(None).cast("timestamp"))
    roles = spark.createDataFrame([("U1", "ROLE1"), ("U3", "ROLE1")], "GRANTEE_NAME string, ROLE string").withColumn("DELETED_ON", F.lit(None).cast("timestamp"))
    wh = spark.createDataFrame([("ROLE1", "WH", "USAGE")], "role string, warehouse string, privilege string")
    assert [tuple(r) for r in access_map.user_warehouses(users, roles, wh).collect()] == [("U1", "ROLE1", "WH", "USAGE")]


def test_user_warehouses_by_holders(spark):
    """Grants given by holders and roles: the pairs are made last, by all tasks, and are those of the table of grants."""
    users = spark.createDataFrame([("U1", None), ("U2", "x"), ("U3", None), ("U3", None), (None, None)], "NAME string, DELETED_ON string")
    holders = spark.createDataFrame([("U1", 0), ("U2", 0), ("U3", 1), ("U4", 1), (None, 1)], "GRANTEE_NAME string, a int")
    roles = spark.createDataFrame([("R1", 0), ("R2", 1), ("R3", 1), (None, 1)], "ROLE string, b int")
    wh = spark.createDataFrame([("R1", "W", "USAGE"), ("R2", "W", "USAGE"), ("R2", "V", "MONITOR")], "role string, warehouse string, privilege string")
    granted = F.col("a") == F.col("b")
    grants = holders.join(roles, granted).select("GRANTEE_NAME", "ROLE", F.lit(None).alias("DELETED_ON"))
    got = access_map.user_warehouses(users, (holders, roles, granted), wh)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, access_map.user_warehouses(users, grants, wh).collect())) and len(rows) == 5
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    first = next(line for line in plan.splitlines() if "Join" in line)
    assert "a#" in first and "b#" in first and got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_cycles_in_role_graph_end(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("x", "y"), ("y", "x")], "parent string, child string")
    paths = {tuple(r.path) for r in graph.simple_paths(edges, graph.top_roots(edges)).collect()}
    assert paths == {("a",), ("a", "b"), ("a", "b", "c")}


def test_merge_intervals(spark):
    cases = {"a": ([(1, 3), (2, 6), (8, 10), (15, 18)], [(1, 6), (8, 10), (15, 18)]), "b": ([(1, 4), (4, 5)], [(1, 5)]), "c": ([(1, 10), (2, 3), (4, 5), (6, 7)], [(1, 10)]), "d": ([(5, 5), (5, 5)], [(5, 5)])}
    frame = spark.createDataFrame([(k, *x) for k, (rows, _) in cases.items() for x in rows], "k string, start int, end int")
    got = {}
    for r in intervals.merge_intervals(frame, ["k"]).orderBy("k", "start").collect():
        got.setdefault(r.k, []).append((r.start, r.end))
    assert got == {k: v for k, (_, v) in cases.items()}


def test_top_k_ties_and_cohorts(spark):
    nums = spark.createDataFrame([(x,) for x in [4, 4, 4, 5, 5, 6, 6, 6, 6, -1, -1, -1]], "v int")
    assert [r.v for r in sales.top_k_frequent(nums, "v", 2).collect()] == [6, 4]
    tx = spark.sql("SELECT * FROM VALUES (1, timestamp_ntz'2025-01-05'), (1, timestamp_ntz'2025-02-01'), (2, timestamp_ntz'2025-01-09'), (3, timestamp_ntz'2025-01-20'), (3, timestamp_ntz'2025-03-02'), (4, timestamp_ntz'2025-02-11') AS t(user_id, ts)")
    rows = [tuple(r)[1:] for r in sales.cohort_retention(tx, max_periods=3).orderBy("cohort").collect()]
    assert rows[0] == (3, 100.0, pytest.approx(33.3), pytest.approx(33.3)) and rows[1] == (1, 100.0, 0.0, 0.0)
    curve = {r.period: r.retention for r in sales.mean_curve(sales.cohort_retention(tx, max_periods=3), known_only=True).collect()}
    assert curve[1] == pytest.approx(33.3)


def test_time_series(spark):
    rows = [(0, None), (1, 1.0), (2, float("nan")), (3, None), (4, 4.0), (7, 7.0), (8, 9.0)]
    frame = spark.createDataFrame(rows, "h int, value double").select((F.lit("2025-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("h"))).alias("ts"), "value")
    reg = timeseries.regularize(frame)
    filled = timeseries.fill_strategies(reg).orderBy("ts").collect()
    assert [r.linear for r in filled] == [None, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 9.0]
    assert [r.ffill for r in filled] == [None, 1.0, 1.0, 1.0, 4.0, 4.0, 4.0, 7.0, 9.0]
    assert filled[0].composite == 1.0
    assert [(r.length) for r in timeseries.long_gaps(reg, min_run=2).orderBy("start").collect()] == [2, 2]
    spike = spark.range(40).select((F.lit("2025-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("ts"), F.when(F.col("id") == 30, 50.0).otherwise(F.col("id") % 3 * 1.0).alias("composite"))
    found = timeseries.rolling_anomalies(spike).where("anomaly").collect()
    assert len(found) == 1 and found[0].composite == 50.0


def test_outliers_nulls_and_truth(spark):
    rows = [("a", float(x % 7)) for x in range(50)] + [("a", 500.0), ("a", float("nan")), ("a", None), (None, 900.0)]
    frame = spark.createDataFrame(rows, "g string, value double")
    scored = outliers.detect_outliers(frame, "value", "g")
    assert [(r.value, r.score) for r in scored.where("outlier").collect()] == [(500.0, 3)]
    assert scored.where("g is null").first().score == 0 and scored.count() == len(rows)
    flat = outliers.detect_outliers(spark.createDataFrame([(1.0,)] * 9 + [(2.0,)], "value double"))
    assert {(r.iqr, r.zscore, r.mad) for r in flat.where("value = 2").collect()} == {(True, False, False)}
    truth = outliers.evaluate_against_truth(scored.withColumn("t", F.col("value") == 500), "t").first()
    assert (truth.tp, truth.precision, truth.recall) == (1, 1.0, 1.0)


def test_upsert_and_versions(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert {tuple(r) for r in upsert.merge(old, new, ["k"]).collect()} == {(1, "a"), (2, "B"), (3, "C"), (None, "n")}
    assert {tuple(r) for r in upsert.merge(old, new, ["k"], update=False).collect()} == {(1, "a"), (2, "b"), (3, "C"), (None, "n")}
    assert {tuple(r) for r in upsert.merge(old, new, ["k"], delete_missing=True).collect()} == {(2, "B"), (3, "C")}
    first = upsert.write_version(old, str(tmp_path))
    second = upsert.write_version(upsert.merge(spark.read.parquet(first), new, ["k"]), str(tmp_path))
    assert first != second and spark.read.parquet(second).count() == 4


def test_lru(spark):
    ops = [("put", 1, 1), ("put", 2, 2), ("get", 1, None), ("put", 3, 3), ("get", 2, None), ("put", 4, 4), ("get", 1, None), ("get", 3, None), ("get", 4, None)]
    log = spark.createDataFrame([("c", i, *o) for i, o in enumerate(ops)], "cache_id string, seq long, op string, key long, value long")
    got = [r.result for r in replay(log, 2).orderBy("seq").collect() if r.op == "get"]
    assert got == [1, -1, -1, 3, 4]


def test_yoy_and_pivot_edges(spark):
    rows = spark.createDataFrame([("a", 2024, 100.0), ("a", 2025, 150.0), ("b", 2025, 5.0), ("c", 2024, 3.0)], "p string, y int, v double")
    got = [(r.p, r.yoy_pct) for r in sales.yoy_growth(rows, ["p"], "y", "v", 2024, 2025).collect()]
    assert got == [("a", 50.0), ("c", -100.0), ("b", None)]
    wide = sales.monthly_pivot(rows, ["p"], F.col("y"), [2024, 2025], "v").orderBy("p").collect()
    assert [tuple(r) for r in wide] == [("a", 100.0, 150.0), ("b", 0.0, 5.0), ("c", 3.0, 0.0)]


def test_refresh_merges_versions(spark, tmp_path):
    edges, grants = (inline(spark, rows, names) for rows, names in ((ROLE_EDGES, "parent, child"), (GRANTS, "role, database, schema, privilege")))
    path, status = access_map.refresh_access_map(edges, grants, str(tmp_path))
    assert spark.read.parquet(path).count() == 5 and status.startswith("access map: 5 rows built, 5 rows")
    fewer = grants.where("database <> 'DB3'")
    again, status = access_map.refresh_access_map(edges, fewer, str(tmp_path), spark.read.parquet(path))
    assert spark.read.parquet(again).count() == 5 and "3 rows built" in status
    assert spark.read.parquet(access_map.refresh_access_map(edges, fewer, str(tmp_path), spark.read.parquet(path), delete_missing=True)[0]).count() == 3
    wh = inline(spark, WAREHOUSES, "role, warehouse, privilege")
    assert "warehouse map: 2 rows built" in access_map.refresh_warehouse_map(edges, wh, str(tmp_path))[1]


def test_thin_interfaces(spark):
    frame = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 2, 1, 99)], "g string, value double")
    assert [outliers.iqr_flags(frame).where("iqr").count(), outliers.mad_flags(frame, group_col="g").where("mad").count(), outliers.zscore_flags(frame, threshold=2.0).where("zscore").count()] == [1, 1, 1]
    checker = fuzzy.SpellChecker(spark.createDataFrame([("hello",)], "word string"), spark.createDataFrame([("help", 3)], "word string, frequency int"))
    asked = spark.createDataFrame([("help",), ("helo",)], "word string")
    assert {tuple(r) for r in checker.is_known(asked).collect()} == {("help", True), ("helo", False)}
    assert [r.suggestion for r in checker.suggest(asked).where("word = 'helo'").orderBy("place").collect()] == ["help", "hello"]
    tx = spark.sql("SELECT * FROM VALUES (1, timestamp_ntz'2025-01-05'), (1, timestamp_ntz'2025-02-01') AS t(user_id, ts)")
    assert sales.render_retention(sales.cohort_retention(tx, max_periods=3)).splitlines()[1].split() == ["2025-01", "1", "100.0", "100.0", "0.0"]
