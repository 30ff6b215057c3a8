import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from panelspark.functions import codes, hashing, nulls
from panelspark.functions import text as X


def test_words_apply_stop_list_and_length_before_stripping(spark):
    df = spark.createDataFrame([("  The, cat ... don't 'quoted' the in\tABC ",)], "t string")
    got = df.select(X.words(F.col("t"), ["the", "and"]).alias("w")).first().w
    # "the," is not the stop word "the"; "..." is long enough and then stripped to nothing
    assert got == ["the", "cat", "", "don't", "quoted", "abc"]


def test_words_of_blank_text(spark):
    df = spark.createDataFrame([("",), ("  ",), (None,)], "t string")
    assert [r.w for r in df.select(X.words(F.col("t"), []).alias("w")).collect()] == [[], [], None]


def test_keywords_are_literal(spark):
    df = spark.createDataFrame([('he said "Vaccine" twice',), ("a survival  rate",), ("SURVIVAL RATE",), ("nothing",), (None,)], "t string")
    assert [r.h for r in df.select(X.contains_any(F.col("t")).alias("h")).collect()] == [True, False, True, False, None]


@pytest.mark.parametrize(
    "location, county, state",
    [
        ("['Some County', 'Some State']", "Some County", "Some State"),
        ("[\"O'Brien County\", 'Iowa']", "OBrien County", "Iowa"),
    ],
)
def test_location_parts(spark, location, county, state):
    r = spark.createDataFrame([(location,)], "l string").select(X.location_county(F.col("l")), X.location_state(F.col("l"))).first()
    assert tuple(r) == (county, state)


def test_post_time_is_utc(spark):
    df = spark.createDataFrame([("Wed Feb 03 13:04:05 +0000 2021",)], "c string")
    assert df.select(F.date_format(X.post_time(F.col("c")), "yyyy-MM-dd HH:mm:ss").alias("t")).first().t == "2021-02-03 13:04:05"


def test_codes(spark):
    df = spark.createDataFrame([(1001,), (48201,), (123456,)], "c int")
    assert rows(df, codes.pad_code(F.col("c")), codes.state_of(F.col("c"))) == [("01001", 1), ("123456", 123), ("48201", 48)]
    g = spark.createDataFrame([("0500000US01001",)], "g string")
    assert g.select(codes.code_from_geo_id(F.col("g"))).first()[0] == 1001


def test_floor_keeps_small_positive_values(spark):
    df = spark.createDataFrame([(-3.0,), (0.0,), (1e-7,), (2.0,)], "x double")
    assert [r[0] for r in df.select(codes.floor_at(F.col("x"))).collect()] == [1e-5, 1e-5, 1e-7, 2.0]


def test_median3(spark):
    df = spark.createDataFrame([(1, 3, 2), (2, 2, 0), (None, 1, 1)], "a int, b int, c int")
    assert [r[0] for r in df.select(codes.median3(F.col("a"), F.col("b"), F.col("c"))).collect()] == [2, 2, None]


def test_nan_becomes_null_and_other_columns_stay(spark):
    df = spark.createDataFrame([(1, float("nan"), "a"), (2, 1.5, None)], "i int, x double, s string")
    assert [tuple(r) for r in nulls.nan_to_null(df).collect()] == [(1, None, "a"), (2, 1.5, None)]


def test_strict_weighted_mean_and_ratio(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 3.0, 3.0), ("b", 1.0, 1.0), ("b", None, 1.0), ("c", 1.0, 0.0)], "g string, x double, w double")
    got = dict(df.groupBy("g").agg(nulls.weighted_mean(F.col("x"), F.col("w"))).collect())
    assert got == {"a": 2.5, "b": None, "c": None}
    assert spark.range(1).select(nulls.ratio(F.lit(1.0), F.lit(0.0)), nulls.inf_to_null(F.lit(math.inf))).first() == (None, None)


def test_sum_of_nothing_is_zero(spark):
    df = spark.createDataFrame([("a", None), ("b", 2)], "g string, x int")
    assert dict(df.groupBy("g").agg(nulls.sum0(F.col("x"))).collect()) == {"a": 0, "b": 2}


def test_hash_is_the_first_eight_hex_digits_of_md5(spark):
    import hashlib

    got = spark.range(5).select(hashing.h32("s", F.col("id"))).collect()
    assert [r[0] for r in got] == [int(hashlib.md5(f"s|{i}".encode()).hexdigest()[:8], 16) for i in range(5)]


def test_risk_formula_by_bayes(spark):
    n, v, c, delta, eff = 1000.0, 300.0, 100.0, 9.0, 0.9
    p = spark.range(1).select(codes.risk_unprotected(F.lit(delta), F.lit(n), F.lit(v), F.lit(c), eff)).first()[0]
    # cases = p among the unprotected plus (1 - efficacy) * p among the protected
    assert p * (n - c - v) + p * (1 - eff) * v == pytest.approx(delta)
