import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from panelspark.operators import skew


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows share one key and one value."""
    rnd = random.Random(1)
    data = [(i, 7 if i % 3 == 0 else rnd.randrange(1000), 5.0 if i % 3 == 0 else rnd.random() * 10) for i in range(3000)]
    return data, spark.createDataFrame(data, "id long, k int, x double").repartition(4)


def test_hot_keys_are_few(hot):
    data, df = hot
    assert [r.k for r in skew.hot_keys(df, ["k"]).collect()] == [7]


def test_copies_follow_a_key_s_share(spark, monkeypatch):
    """As many copies as parts of its rows, few in all, and about the same from a sample."""
    df = spark.range(40_000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 1 WHEN id % 20 = 1 THEN 2 ELSE id END AS k")
    assert {r.k: r._copies for r in skew.hot_keys(df, ["k"], share=40).collect()} == {1: 21, 2: 3}
    monkeypatch.setattr(skew, "SAMPLED", 4000)
    some = {r.k: r._copies for r in skew.hot_keys(df, ["k"], share=40).collect()}
    assert set(some) == {1, 2} and abs(some[1] - 21) <= 2 and abs(some[2] - 3) <= 1
    dim = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, name string")
    got = skew.salted_join(df, dim, ["k"], spread=["id"])
    assert rows(got.groupBy("name").count(), "name", "count") == [("a", 20_000), ("b", 2000), ("c", 1)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_salted_join_equals_plain_join(spark, hot, how):
    data, df = hot
    dim = spark.createDataFrame([(k, f"n{k}") for k in range(0, 900)], "k int, name string")
    got = skew.salted_join(df, dim, ["k"], how)
    want = df.join(dim, "k", how).select(*got.columns)
    assert rows(got, *got.columns) == rows(want, *got.columns)


def test_salted_join_spreads_the_hot_key(spark, hot):
    _, df = hot
    dim = spark.createDataFrame([(7, "hot"), (8, "cold")], "k int, name string")
    plan = skew.salted_join(df, dim, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


def test_null_safe_salted_join(spark):
    big = spark.createDataFrame([(1, None), (2, "a"), (3, None), (4, "b")], "id long, text string")
    dim = spark.createDataFrame([(None, 0), ("a", 1)], "text string, label int")
    assert rows(skew.salted_join(big, dim, ["text"], null_safe=True), "id", "label") == [(1, 0), (2, 1), (3, 0)]


def test_keep_first_takes_the_whole_smallest_row(spark):
    df = spark.createDataFrame([("a", 2, None), ("a", 1, "x"), ("b", 3, "y"), ("a", 1, "z")], "k string, o int, v string")
    assert rows(skew.keep_first(df, ["k"], ["o", "v"]), "k", "o", "v") == [("a", 1, "x"), ("b", 3, "y")]


@pytest.mark.parametrize("grouped", [False, True])
def test_positions_number_every_row_once(spark, hot, grouped):
    data, df = hot
    df = df.withColumn("g", (F.col("id") % 2).cast("int"))
    group = ["g"] if grouped else []
    got = skew.positions(df, "x", group, ["id"]).collect()
    for g in (0, 1) if grouped else (None,):
        part = [r for r in got if g is None or r.g == g]
        assert sorted(r.pos for r in part) == list(range(len(part)))
        assert all(r.n == len(part) for r in part)
        assert [r.x for r in sorted(part, key=lambda r: r.pos)] == sorted(r.x for r in part)


def test_positions_split_a_hot_value(spark, hot):
    _, df = hot
    ranges = skew.in_order(df, ["x", "id"]).where("x = 5.0").groupBy("_part").count().collect()
    assert len(ranges) >= 2 and max(r["count"] for r in ranges) < 700
    assert skew.positions(df, "x", tie=["id"]).count() == 3000


def test_positions_skip_missing_values(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0)], "id int, x double")
    assert [(r.id, r.pos, r.n) for r in skew.positions(df, "x", tie=["id"]).collect()] == [(2, 0, 1)]


def test_prefix_sums(spark, hot):
    data, df = hot
    counts = df.groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    got = {r.x: (r.c_below, r.c_all) for r in skew.prefix_sums(counts, "x", ["c"]).collect()}
    want, total = {}, 0
    for x in sorted({x for _, _, x in data}):
        want[x] = total, len(data)
        total += sum(1 for _, _, y in data if y == x)
    assert got == want


def test_hot_null_is_spread_in_a_left_join(spark):
    big = spark.range(2000).select("id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("k"))
    dim = spark.createDataFrame([(2, "two"), (4, "four")], "k long, name string")
    got = skew.salted_join(big, dim, ["k"], "left")
    assert rows(got.where("name IS NOT NULL"), "id", "name") == [(2, "two"), (4, "four")]
    assert got.count() == 2000 and skew.hot_keys(big, ["k"]).count() == 1


def test_ranges_hold_even_parts_in_order(spark, hot):
    _, df = hot
    parts = skew.in_order(df, ["x", "id"]).groupBy("_part").agg(F.min("x"), F.max("x"), F.count("x"), F.max("_place")).orderBy("_part").collect()
    assert all(a[2] <= b[1] for a, b in zip(parts, parts[1:]))
    assert all(r[3] == r[4] + 1 for r in parts)
    assert max(r[3] for r in parts) < 3000 / len(parts) * 1.6 and len(parts) == skew.tasks(df)


@pytest.mark.parametrize("rows", [0, 100_000])
def test_beside_small_and_large_tables(spark, hot, monkeypatch, rows):
    """With and without a broadcast, missing keys being equal."""
    monkeypatch.setattr(skew, "BROADCAST_ROWS", rows)
    data, df = hot
    df = df.withColumn("k", F.when(F.col("k") < 900, F.col("k")))
    dim = df.select("k").distinct().withColumn("name", F.concat(F.lit("n"), F.coalesce("k", F.lit(-1))))
    got = skew.beside(df, dim, ["k"], spread=["id"])
    assert got.count() == len(data) and got.where("name = concat('n', coalesce(k, -1))").count() == len(data)


def test_no_array_rides_on_the_rows(spark, hot):
    _, df = hot
    for out in (skew.positions(df, "x", tie=["id"]), skew.prefix_sums(df.groupBy("x").count(), "x", ["count"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "aggregate(" not in plan and "NestedLoop" not in plan
