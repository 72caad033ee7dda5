import csv
import logging

import pytest

from millrace.sources import csv_files, extract, json_sink, synthetic

GOOD = {"oracle": {"dsn": "h:1521/X", "user": "u", "password": "p"}, "sql": "select 1", "output": {"local_dir": "", "base_filename": "part", "records_per_file": 10}, "s3": {"bucket": "b"}}


def changed(**sections):
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in GOOD.items()}
    for name, change in sections.items():
        if change is None:
            del out[name]
        else:
            out[name] = {k: v for k, v in {**out[name], **change}.items() if v is not ...}
    return out


@pytest.mark.parametrize("raw", [
    [], changed(sql=None), changed(oracle={"dsn": ...}), changed(oracle={"thick_mode": "yes"}), changed(oracle={"password": ""}), changed(oracle={"client_lib_dir": 3}),
    changed(oracle={"auth_method": "aws_secret"}), changed(oracle={"auth_method": "magic"}), changed(output={"records_per_file": "x"}), changed(output={"records_per_file": 0}), changed(s3={"bucket": ...}),
])
def test_bad_configurations(raw):
    with pytest.raises(extract.ConfigError):
        extract.parse_config(raw)


def test_helpers():
    config = extract.parse_config(changed())
    assert config.csv["delimiter"] == "," and config.cleanup_local
    assert extract.redact({"Password": "x", "a": [{"token": "t", "b": ""}]}) == {"Password": "***REDACTED***", "a": [{"token": "***REDACTED***", "b": ""}]}
    assert extract.human_bytes(1536) == "1.50 KiB" and extract.rate(10, 4) == "2.5/s" and extract.rate(3, 0) == "3/s"
    assert not extract.send_mail({"enabled": False}, "s", "t")
    waits = []
    assert not extract.send_mail({"enabled": True, "smtp_server": "127.0.0.1", "port": 9, "from_addr": "a@b", "to_addr": "c@d"}, "s", "t", pause=waits.append)
    assert waits == [1.0, 2.0]


def test_chunked_csv_upload_and_exit_codes(spark, tmp_path):
    local, remote = tmp_path / "local", tmp_path / "remote"
    local.mkdir(), remote.mkdir()
    rows = spark.createDataFrame([(i, f'say "{i}",\n', None if i % 2 else "") for i in range(25)], "id int, a string, b string").repartition(4)
    written = extract.write_csv_files(rows, str(local), "part", 10, order=("id",))
    files = [f["path"] for f in written]
    assert [(f["chunk"], f["rows"], f["bytes"]) for f in written] == [(i, n, (local / f"part_{i + 1}.csv").stat().st_size) for i, n in enumerate((10, 10, 5))]
    assert sorted(p.name for p in local.iterdir()) == ["_part.manifest", "part_1.csv", "part_2.csv", "part_3.csv"]
    assert [f.rsplit("/", 1)[1] for f in files] == ["part_1.csv", "part_2.csv", "part_3.csv"]
    read = [list(csv.reader(open(f, newline="", encoding="utf-8"))) for f in files]
    assert [len(x) - 1 for x in read] == [10, 10, 5] and [int(r[0]) for x in read for r in x[1:]] == list(range(25))
    assert read[0][1][1] == 'say "0",\n'
    path = tmp_path / "c.yaml"
    import yaml

    path.write_text(yaml.safe_dump(changed(output={"local_dir": str(local)})))
    run = lambda df: extract.main([str(path)], spark=spark, read=lambda s, c: df, target=str(remote))
    assert run(rows) == 0 and len(list(remote.glob("part_*.csv"))) == 3 and not list(local.glob("part_*.csv"))
    assert run(rows.limit(0)) == 0
    assert extract.main([str(tmp_path / "none.yaml")], spark=spark) == 2

    def broken(s, c):
        raise RuntimeError("no database")

    assert extract.main([str(path)], spark=spark, read=broken) == 5
    path.write_text(yaml.safe_dump(changed(oracle={"auth_method": "aws_secret", "secret_name": "n"}, output={"local_dir": str(local)})))
    assert extract.main([str(path)], spark=spark) == 3


@pytest.mark.parametrize("parts", [1, 7])
def test_csv_files_over_any_partitioning(spark, tmp_path, parts):
    rows = [(i, None if i % 5 == 0 else f"a,{i}" if i % 3 else 'q"\r\n"') for i in range(101)]
    df = spark.createDataFrame(rows, "id int, a string").repartition(parts)
    written = extract.write_csv_files(df, f"file:{tmp_path}/new/folder", "t", 4, delimiter=";", include_header=False, order=("id",))
    read = [[(int(i), a) for i, a in csv.reader((tmp_path / "new/folder" / f"t_{n + 1}.csv").open(newline="", encoding="utf-8"), delimiter=";")] for n in range(26)]
    assert [len(r) for r in read] == [4] * 25 + [1] == [f["rows"] for f in written]
    assert [r for part in read for r in part] == [(i, a or "") for i, a in rows]
    assert extract.write_csv_files(df.limit(0), str(tmp_path), "none", 4) == [] and [p.name for p in tmp_path.glob("*none*")] == ["_none.manifest"]


def test_a_write_without_all_chunks_leaves_nothing(spark, tmp_path):
    split = spark.createDataFrame([(0, "a"), (0, "b")], "chunk long, line string").repartition(2)
    missing = spark.createDataFrame([(1, "a")], "chunk long, line string")
    twice = spark.createDataFrame([(0, "a"), (1, "b"), (0, "c")], "chunk long, line string").coalesce(1)
    for rows in (split, missing, twice):
        with pytest.raises(Exception, match="missing, or are split"):
            csv_files.write_chunks(rows, str(tmp_path), "x", None)
        assert not list(tmp_path.iterdir())


def test_json_sinks_and_logger(spark, tmp_path):
    import json

    frame = spark.sql("SELECT 2 AS b, 'x' AS a UNION ALL SELECT 1, 'y'")
    assert json_sink.write_json_array(frame, str(tmp_path / "o.json"), ("b",)) == 2
    assert json.loads((tmp_path / "o.json").read_text()) == [{"a": "y", "b": 1}, {"a": "x", "b": 2}]
    json_sink.write_json_lines(frame, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 2
    log = extract.file_logger(str(tmp_path), "job", debug=True)
    log.error("bad"), log.debug("fine")
    logging.shutdown()
    assert "bad" in (tmp_path / "job.error").read_text() and "fine" in (tmp_path / "job.debug").read_text()


def test_synthetic_tables(spark):
    sales = synthetic.make_sales(spark, 500)
    assert sales.count() == 500 and sales.where("qty < 1 or qty > 9 or year not in (2024, 2025)").count() == 0
    assert synthetic.make_transactions(spark, 100, 6).selectExpr("count(distinct user_id) n").first().n == 100
    assert 200 < synthetic.make_sensor_stream(spark).count() < 336
    assert 20 < synthetic.make_outliers(spark).where("is_planted_extreme").count() < 110
