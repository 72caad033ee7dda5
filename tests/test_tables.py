import logging

import pytest
from pyspark.sql import functions as F

from millrace.functions import semi
from millrace.operators import access_map, graph, tables, upsert
from millrace.session import warehouse
from millrace.sources import extract, json_sink


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_merge_fails_on_two_source_rows_of_one_key(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    twice = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    for changed in (upsert.merge(target, twice, ["k"]), upsert.update_column(target, twice, ["k"], "v")):
        with pytest.raises(Exception, match="several source rows"):
            changed.collect()
    nulls = spark.createDataFrame([(None, "x"), (None, "y"), (3, "c")], "k int, v string")
    assert rows(upsert.merge(target, nulls, ["k"])) == sorted([(1, "a"), (2, "b"), (None, "x"), (None, "y"), (3, "c")], key=str)


def test_catalog_tables(spark):
    spark.sql("DROP TABLE IF EXISTS t_made")
    try:
        tables.create_or_replace(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), "t_made")
        tables.insert_select(spark.createDataFrame([(3,)], "k int"), "t_made")
        assert rows(warehouse(spark, name="t_made")) == [(1, "a"), (2, "b"), (3, None)]
        tables.reload(spark.table("t_made").where("k > 1"), "t_made")
        assert rows(warehouse(spark, "SELECT * FROM t_made")) == [(2, "b"), (3, None)]
        tables.create_or_replace(spark.table("t_made").withColumn("n", F.lit(1)), "t_made")
        assert rows(spark.table("t_made")) == [(2, "b", 1), (3, None, 1)]
    finally:
        spark.sql("DROP TABLE IF EXISTS t_made")
    with pytest.raises(ValueError):
        warehouse(spark)


def test_versions_of_a_table(spark, tmp_path):
    t = tables.Versioned(spark, str(tmp_path / "t"))
    assert not t.exists()
    with pytest.raises(FileNotFoundError):
        t.read()
    t.insert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    before = t.read()
    t.merge(spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string"), ["k"])
    t.update(spark.createDataFrame([(1, "A")], "k int, v string"), ["k"], "v")
    assert rows(t.read()) == [(1, "A"), (2, "B"), (3, "c")] and rows(before) == [(1, "a"), (2, "b")]
    t.truncate()
    assert rows(t.read()) == [] and t.read().columns == ["k", "v"]


def test_semi_structured_values(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": "7"}, "xs": [{"n": 2}, {"n": 1}]}'), (2, '{"xs": []}'), (3, None), (4, '{"a": 5}')], "i int, j string")
    v = df.select("i", semi.parse(F.col("j")).alias("v"))
    assert rows(v.select("i", semi.at(F.col("v"), "a.b", "int"))) == [(1, 7), (2, None), (3, None), (4, None)]
    flat = semi.flatten(v, F.col("v"), "xs", "x").select("i", semi.at(F.col("x"), "n", "int").alias("n"))
    assert [tuple(r) for r in flat.orderBy("n").collect()] == [(1, 1), (1, 2)]
    assert semi.flatten(v, F.col("v"), "xs", outer=True).count() == 5
    bad = spark.createDataFrame([("{",)], "j string")
    assert bad.select(semi.parse(F.col("j"), strict=False)).first()[0] is None


def test_single_json_file(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "é")], "k int, v string").repartition(2)
    size = json_sink.write_json_file(df, str(tmp_path / "out.json"))
    text = (tmp_path / "out.json").read_text(encoding="utf-8")
    assert sorted(text.split()) == ['{"k":1}', '{"k":2,"v":"é"}'] and size == len(text.encode())
    with pytest.raises(ValueError):
        json_sink.write_json_file(df, str(tmp_path / "big.json"), max_bytes=3)
    assert not (tmp_path / "big.json").exists()


def test_redaction_of_nested_values():
    deep = inner = {}
    for _ in range(30):
        inner["x"] = inner = {}
    assert "<max-depth>" in str(extract.redact(deep)) and str(deep).count("x") == 30
    assert extract.redact({"TOKEN": 0, "secret": "s", "list": [{"pwd": "p"}, ("a", {"token": "t"})]}) == {"TOKEN": 0, "secret": "***REDACTED***", "list": [{"pwd": "***REDACTED***"}, ["a", {"token": "***REDACTED***"}]]}
    assert [extract.human_bytes(n) for n in (0, 1, 1023, 1024, 1 << 30, 1 << 55)] == ["0.00 B", "1.00 B", "1023.00 B", "1.00 KiB", "1.00 GiB", "32768.00 TiB"]


def test_log_files_and_secrets(spark, tmp_path):
    import yaml

    config = {"oracle": {"dsn": "h", "user": "u", "password": "p"}, "sql": "s", "output": {"local_dir": str(tmp_path), "base_filename": "p", "records_per_file": 2}, "s3": {"bucket": "b"}, "logging": {"root_directory": str(tmp_path / "log"), "process_name": "job"}}
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(config))
    (tmp_path / "up").mkdir()
    try:
        assert extract.main(["-v", str(tmp_path / "c.yaml")], spark=spark, read=lambda s, c: spark.range(5), target=str(tmp_path / "up")) == 0
    finally:
        logging.getLogger("millrace").handlers.clear()
    assert "3 files" in (tmp_path / "log" / "job.log").read_text()
    with pytest.raises(extract.SecretsError):
        extract.aws_secret("name", None)


def test_paths_beyond_the_row_limit_of_a_recursive_query(spark):
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    chain = spark.range(150).select(F.col("id").cast("string").alias("parent"), (F.col("id") + 1).cast("string").alias("child"))
    assert graph.simple_paths(chain, chain.where("parent = '140'").select(F.col("parent").alias("root")), 200).count() == 11
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == limit
    wide = spark.range(300).select(F.lit("r").alias("parent"), F.concat(F.lit("c"), "id").alias("child"))
    assert graph.simple_paths(wide, graph.top_roots(wide)).count() == 301


def test_inserts_add_files_and_a_lost_race_fails(spark, tmp_path):
    t = tables.Versioned(spark, str(tmp_path / "t"))
    t.replace(spark.createDataFrame([(1, "a")], "k int, v string"))
    before, reader = t._files(), t.read()
    t.insert(spark.createDataFrame([(2,)], "k int"))
    t.insert(spark.createDataFrame([(3, 0.5)], "k int, extra double"))
    assert t._files()[: len(before)] == before and len(t._files()) == 3  # nothing was written again
    assert sorted(map(tuple, t.read().select("k", "v", "extra").collect()), key=str) == [(1, "a", None), (2, None, None), (3, None, 0.5)]
    assert [tuple(r) for r in reader.collect()] == [(1, "a")]
    late = tables.Versioned(spark, str(tmp_path / "t"))
    late._numbers = lambda: ["000000000001"]  # saw the table before the last insert
    with pytest.raises(OSError):
        late.replace(spark.createDataFrame([(9, "z")], "k int, v string"))
    assert t.read().count() == 3


def test_cursor_block_gives_the_rows_of_the_set_based_form(spark):
    edges = spark.createDataFrame([("m1", "b"), ("M2", "b"), ("b", "c"), ("c", "b"), ("m1", "o'x"), (None, "y"), ("z", None)], "parent string, child string")
    roles = spark.createDataFrame([("m1",), ("M2",), ("m3",), ("b",), (None,)], "role string")
    grants = spark.createDataFrame([("c", "D", "S", "USAGE"), ("c", "D", "S", "SELECT"), ("b", "D", None, "USAGE"), ("o'x", "E", "T", None)], "role string, database string, schema string, privilege string")
    rows = [sorted(map(str, f(edges, roles, grants, "m").collect())) for f in (access_map.audit_block, access_map.audit_rows)]
    assert rows[0] == rows[1] and len(rows[0]) == 8
