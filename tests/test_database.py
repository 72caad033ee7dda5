"""Reading a query over JDBC in parallel, from the embedded database that comes with Spark."""

import uuid

import pytest

from millrace.sources import extract


@pytest.fixture(scope="module")
def database(spark):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    # nine tenths of the keys in a hundredth of their range, some null, some repeated
    rows = [(i % 900, f"dense {i}") for i in range(9000)] + [(1000 + 97 * i, f"thin {i}") for i in range(900)] + [(None, f"none {i}") for i in range(50)] + [(-5, "low")]
    spark.createDataFrame(rows, "K int, V string").write.jdbc(url, "T", mode="append", properties={"user": "app", "password": "x"})
    return url, rows


def config(fetch, sql="SELECT K, V FROM T"):
    return extract.parse_config({"oracle": {"dsn": "here", "user": "app", "password": "x"}, "sql": sql, "output": {"local_dir": "x", "base_filename": "y", "records_per_file": 10}, "s3": {"bucket": "b"}, "fetch": fetch})


def read(spark, database, fetch, sql="SELECT K, V FROM T"):
    return extract.jdbc_reader(spark, config(fetch, sql), url=database[0])


def test_ranges_follow_the_keys(spark, database):
    df = read(spark, database, {"partition_column": "K", "num_partitions": 6})
    sizes = df.rdd.glom().map(len).collect()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(database[1], key=str)
    assert 5 <= len(sizes) <= 10 and sum(sizes) == len(database[1]) and max(sizes) < 1.6 * len(database[1]) / 6
    thin = read(spark, database, {"partition_column": "K", "num_partitions": 4}, "SELECT K, V FROM T WHERE K >= 1000")
    sizes = thin.rdd.glom().map(len).collect()
    assert sum(sizes) == 900 and len(sizes) == 4 and max(sizes) < 1.3 * 225


def test_given_bounds_one_partition_and_nothing(spark, database):
    want = sorted(database[1], key=str)
    for fetch in ({}, {"array_size": 7}, {"partition_column": "K", "lower_bound": 0, "upper_bound": 900, "num_partitions": 3}):
        assert sorted(map(tuple, read(spark, database, fetch).collect()), key=str) == want
    for where, n in (("K IS NULL", 50), ("K = -5", 1), ("K > 1000000", 0)):
        assert read(spark, database, {"partition_column": "K", "num_partitions": 4}, f"SELECT K, V FROM T WHERE {where}").count() == n
