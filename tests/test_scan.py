"""Running values, global windows and quantiles by selection against plain loops."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.operators import intervals, outliers, sales, timeseries
from millrace.operators.quantiles import double_of, group_quantiles, sortable
from millrace.plans import scan
from millrace.plans.checkpoints import cut


@pytest.fixture(autouse=True)
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_values(spark):
    rng = random.Random(1)
    rows = [(i * 3, rng.choice([None, 1, 2, 3, -4]), rng.choice([None, "a", "b"])) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, v long, s string").repartition(5)
    got = scan.running(scan.ordered(df, ["k"]), ["k"], total=("sum", F.col("v")), most=("max", F.col("v")), reach=("before", F.col("v")), seen=("last", F.col("s")), soon=("next", F.col("s")))
    assert scan.ordered(df, ["k"]).select(scan.PART).distinct().count() > 1
    total, most, seen, soon, want = 0, None, None, None, []
    for k, v, s in sorted(rows):
        reach, total, most, seen = most, total + (v or 0), most if v is None else v if most is None else max(most, v), s or seen
        want.append([k, total, most, reach, seen])
    for x, (_, _, s) in zip(reversed(want), reversed(sorted(rows)), strict=True):
        soon = s or soon
        x.append(soon)
    assert [[r.k, r.total, r.most, r.reach, r.seen, r.soon] for r in got.orderBy("k").collect()] == want
    empty = df.where("false")
    assert scan.running(scan.ordered(empty, ["k"]), ["k"], total=("sum", F.col("v"))).collect() == []


def test_blocks_hold_what_precedes(spark):
    df = spark.range(1, 101).withColumnRenamed("id", "n")
    for reach, size in ((3, 10), (12, 4), (0, 7)):
        held = {}
        for r in scan.blocks(df, "n", reach, size).collect():
            held.setdefault(r._block, {})[r.n] = r._own
        own = sorted(n for b in held.values() for n, o in b.items() if o)
        assert own == list(range(1, 101))
        for b in held.values():
            for n in (n for n, o in b.items() if o):
                assert all(m in b for m in range(max(1, n - reach), n))


def test_global_windows_equal_windows_of_one_key(spark):
    rng = random.Random(3)
    rows = [(f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00", float(rng.randint(0, 50)) if rng.random() < 0.6 else None) for i in range(5 * 24, 700)]
    df = spark.createDataFrame(rows, "t string, value double").select(F.to_timestamp_ntz("t").alias("ts"), "value")
    reg = cut(timeseries.regularize(df))
    keyed = reg.withColumn("one", F.lit(1))
    same = lambda a, b, cols: sorted(map(str, a.select(*cols).collect())) == sorted(map(str, b.select(*cols).collect()))
    filled = timeseries.fill_strategies(reg)
    assert same(filled, timeseries.fill_strategies(keyed, ["one"]), ["ts", "ffill", "linear", "seasonal", "composite"])
    assert same(timeseries.long_gaps(reg, min_run=2), timeseries.long_gaps(keyed, ["one"], min_run=2), ["start", "end", "length"])
    assert same(timeseries.rolling_anomalies(filled), timeseries.rolling_anomalies(timeseries.fill_strategies(keyed, ["one"]), ["one"]), ["ts", "roll_mean", "roll_std", "z", "anomaly"])
    sold = spark.createDataFrame([(i % 90, i) for i in range(1000)], "p int, m long")
    assert same(sales.rolling_trend(sold, [], "p", "m"), sales.rolling_trend(sold.withColumn("g", F.lit(1)), ["g"], "p", "m"), ["p", "m", "rev_rolling_3m"])
    plan = filled._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_merge_all_intervals(spark):
    rng = random.Random(5)
    rows = [(s := rng.randint(0, 4000), s + rng.choice([0, 1, 3, 10])) for _ in range(700)] + [(100, 100), (None, 3), (7, None), (5000, 9000), (5001, 5002)]
    got = [tuple(r) for r in intervals.merge_intervals(spark.createDataFrame(rows, "start int, end int").repartition(6)).orderBy("start").collect()]
    want = []
    for s, e in sorted(r for r in rows if None not in r):
        if want and s <= want[-1][1]:
            want[-1][1] = max(want[-1][1], e)
        else:
            want.append([s, e])
    assert got == [tuple(w) for w in want]


VALUES = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 1.7976931348623157e308, -1.7976931348623157e308, 0.1, 0.2, 0.30000000000000004, float("inf"), float("-inf"), 123.456, -99.5]


def test_bits_sort_like_doubles(spark):
    got = spark.createDataFrame([(x,) for x in VALUES], "x double").select("x", sortable(F.col("x")).alias("k")).withColumn("y", double_of(F.col("k"))).collect()
    assert all(r.x == r.y for r in got)
    assert [r.x for r in sorted(got, key=lambda r: (r.k, r.x))] == sorted(VALUES)


@pytest.mark.parametrize("seed", [1, 2])
def test_quantiles_against_duckdb(spark, seed):
    rng = random.Random(seed)
    kinds = [lambda: rng.gauss(0, 1), lambda: float(rng.randint(0, 3)), lambda: rng.choice(VALUES[:-4]), lambda: rng.expovariate(1) * 1e6, lambda: None, lambda: float("nan")]
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice(kinds)()) for _ in range(900)] + [("one", 4.5), ("none", None), *(("same", 2.5) for _ in range(300))]
    shares, names = (0.0, 0.25, 0.5, 0.9, 1.0), ("q0", "q1", "q2", "q3", "q4")
    got = {r.g: tuple(r)[1:] for r in group_quantiles(spark.createDataFrame(rows, "g string, x double").repartition(4), "x", shares, names, "g").collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t(g VARCHAR, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [(g, x) for g, x in rows if x is not None and not math.isnan(x)])
    want = {r[0]: r[1:] for r in con.sql(f"SELECT g, {', '.join(f'quantile_cont(x, {s})' for s in shares)} FROM t GROUP BY g").fetchall()}
    assert got.keys() == want.keys()
    for g in want:
        assert got[g] == pytest.approx(want[g], rel=1e-15, abs=0), g
    frame = spark.createDataFrame([r for r in rows if r[0] == "a"], "g string, x double")
    assert tuple(group_quantiles(frame, "x", shares, names).first()) == got["a"]
    assert group_quantiles(frame.where("false"), "x", shares, names).collect() == []


def test_no_group_state(spark):
    df = spark.createDataFrame([(1, 2.0)], "g int, value double")
    assert "percentile" not in outliers.detect_outliers(df, "value", "g")._jdf.queryExecution().executedPlan().toString().lower()
