import random

import numpy as np
import pytest
from conftest import d, rows
from pyspark.sql import functions as F

from panelspark.operators import stats as st


@pytest.fixture(scope="module")
def sample(spark):
    rnd = random.Random(1)
    data = [(i, "ab"[i % 2], 1.0 if i % 3 == 0 else rnd.gauss(0, 1)) for i in range(600)]
    return data, spark.createDataFrame(data, "id int, g string, x double").repartition(3)


def test_quantiles(spark, sample):
    data, df = sample
    probs = [0.0, 0.025, 0.5, 0.9, 1.0]
    got = {(r.g, r.prob): r.value for r in st.quantiles(df, "x", probs, ["g"]).collect()}
    for g in "ab":
        for p in probs:
            assert got[(g, p)] == pytest.approx(np.quantile([x for _, h, x in data if h == g], p))
    whole = {r.prob: r.value for r in st.quantiles(df, "x", probs).collect()}
    assert whole == {p: pytest.approx(np.quantile([x for _, _, x in data], p)) for p in probs}


def test_quantile_of_one_and_of_missing(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", None), ("c", 1.0), ("c", None), ("c", 2.0)], "g string, x double")
    assert rows(st.quantiles(df, "x", [0.25], ["g"]), "g", "value") == [("a", 3.0), ("c", 1.25)]


@pytest.mark.parametrize("most", [3, 50, 10**6])
def test_quantiles_in_more_rounds(spark, sample, monkeypatch, most):
    """Brackets narrowed by further sketches give the same values, with coarse sketches and missing groups too."""
    monkeypatch.setattr(st, "SORTED", most)
    monkeypatch.setattr(st, "GRID", 40)
    data, df = sample
    df = df.withColumn("g", F.when(F.col("g") == "a", F.col("g")))
    got = {(r.g, r.prob): r.value for r in st.quantiles(df, "x", [0.1, 0.5, 0.99], ["g"]).collect()}
    want = {(g, p): np.quantile([x for _, h, x in data if h == (g or "b")], p) for g in ("a", None) for p in (0.1, 0.5, 0.99)}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    whole = {r.prob: r.value for r in st.quantiles(df, "x", [0.1, 0.5]).collect()}
    assert whole == {p: pytest.approx(np.quantile([x for _, _, x in data], p)) for p in (0.1, 0.5)}


def test_quantiles_move_only_what_lies_in_a_bracket(spark):
    """A task sends one row per gap and the few distinct values of the brackets, not the column."""
    df = spark.range(200_000, numPartitions=4).selectExpr("hash(id) * 1.0D AS x", "id % 2 AS g")
    out = st.quantiles(df, "x", [0.25, 0.5], ["g"])
    out.collect()
    plan = out._jdf.queryExecution().executedPlan()
    assert "rangepartitioning" not in plan.toString()
    cells = df.join(st._brackets(df.select("g", F.col("x").alias("_v")), ["g"], [0.25, 0.5])[0], "g")
    inside = cells.where("x between _lo0 and _hi0 or x between _lo1 and _hi1").count()
    assert 0 < inside < 200_000 / 50


def test_quantiles_of_many_groups(spark, monkeypatch):
    """More groups than may be broadcast."""
    monkeypatch.setattr("panelspark.operators.skew.BROADCAST_ROWS", 5)
    df = spark.range(900).selectExpr("id * 1.0D AS x", "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 41 END AS g")
    got = {r.g: r.value for r in st.quantiles(df, "x", [0.5], ["g"]).collect()}
    want = {}
    for i in range(900):
        want.setdefault(0 if i % 3 == 0 else i % 41, []).append(i)
    assert got == {g: pytest.approx(np.median(v)) for g, v in want.items()}


def test_quantiles_of_no_rows_and_of_not_a_number(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", 1.0), ("b", None)], "g string, x double")
    assert st.quantiles(df.limit(0), "x", [0.5]).count() == 0
    assert st.quantiles(df, "x", [0.0], ["g"]).collect() == [("a", 0.0, 1.0)]


def test_interval_summary(spark):
    x = [0.5, -0.1, 0.9, 1.4, 0.3]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    r = st.interval_summary(df, "x").first()
    lo, hi = np.quantile(x, [0.025, 0.975])
    assert (r.n, r.mean, r.lower, r.upper) == (5, pytest.approx(np.mean(x)), pytest.approx(lo), pytest.approx(hi))
    assert r.half_width == pytest.approx(max(np.mean(x) - lo, hi - np.mean(x)))
    assert r.sem == pytest.approx(np.std(x, ddof=1) / 5**0.5)
    assert r.p == pytest.approx(2 / 6)  # mean above 0: one value at or below it
    assert st.interval_summary(df, "x", tail="upper").first().p == pytest.approx(5 / 6)


def test_highest_density_against_sliding_window(spark, sample):
    data, df = sample
    got = {r.g: (r.lower, r.upper) for r in st.highest_density(df, "x", ["g"], ["id"], 0.8).collect()}
    for g in "ab":
        x = np.sort([v for _, h, v in data if h == g])
        k = int(np.floor(0.8 * len(x)))
        widths = x[k:] - x[: len(x) - k]
        i = int(np.argmin(widths))
        assert got[g] == (x[i], x[i + k])


def test_density(spark, sample):
    data, df = sample
    got = st.density(df, "x", ["g"], 50).where("g = 'a'").orderBy("i").collect()
    x = np.array([v for _, h, v in data if h == "a"])
    bw = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min() - 3 * bw, x.max() + 3 * bw, 50)
    want = [np.mean(np.exp(-0.5 * ((t - x) / bw) ** 2) / (bw * np.sqrt(2 * np.pi))) for t in grid]
    assert [r.x for r in got] == pytest.approx(grid)
    assert [r.density for r in got] == pytest.approx(want)


def test_correlation_skips_incomplete_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 1.0, None), (3.0, 5.0, 2.0), (4.0, 4.0, 9.0)], "a double, b double, c double")
    got = {(r.a, r.b): r["corr"] for r in st.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert got[("a", "b")] == pytest.approx(np.corrcoef([1, 2, 3, 4], [2, 1, 5, 4])[0, 1])
    assert got[("a", "c")] == pytest.approx(np.corrcoef([1, 3, 4], [1, 2, 9])[0, 1])


def test_first_and_last_skip_missing_per_column(spark):
    df = spark.createDataFrame([(1, d(0), None, 1.0), (1, d(1), 5.0, 2.0), (1, d(2), 6.0, None), (2, d(0), None, 3.0)], "region int, date date, x double, y double")
    assert rows(st.last_values(df, ["x", "y"]), "region", "x", "y") == [(1, 6.0, 2.0), (2, None, 3.0)]
    assert rows(st.first_values(df, ["x", "y"]), "region", "x", "y") == [(1, 5.0, 1.0), (2, None, 3.0)]


def test_scalers_and_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, k double")
    assert rows(st.standard_scaled(df, ["x", "k"]), "x", "k") == [(-1.0, 0.0), (1.0, 0.0)]
    assert rows(st.min_max_scaled(df, ["x", "k"]), "x", "k") == [(0.0, 0.0), (1.0, 0.0)]


def test_weighted_means_shares_change(spark):
    df = spark.createDataFrame([(d(0), 1.0, 1.0), (d(0), 4.0, 2.0), (d(1), None, 1.0), (d(1), 2.0, 1.0)], "date date, x double, w double")
    assert rows(st.weighted_means(df, ["x"], "w", ["date"]), "date", "x") == [(d(0), 3.0), (d(1), None)]
    assert [r.share for r in st.shares(df, "w").orderBy("share").collect()] == [0.2, 0.2, 0.2, 0.4]
    assert st.change_between(df, ["w"], F.lit(d(0)), F.lit(d(1))).first().w == -1.0


def test_log_histogram_and_explained_variance(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (9.0,), (10.0,), (100.0,), (1000.0,)], "x double")
    assert rows(st.log_histogram(df, "x", 0, 2, 2), "bin", "n") == [(0, 2), (1, 2)]
    y = spark.createDataFrame([(1.0, 1.5), (2.0, 1.5), (4.0, 4.5)], "y double, h double")
    r = y.agg(st.explained_variance(F.col("y"), F.col("h")).alias("e")).first().e
    assert r == pytest.approx(1 - np.var([-0.5, 0.5, -0.5]) / np.var([1, 2, 4]))


def test_log_likelihood_and_distinct_counts(spark):
    df = spark.createDataFrame([("v", 0, 0, 0, -1.0), ("w", 0, 0, 0, -2.0), ("v", 0, 1, 0, -4.0)], "variable string, chain int, draw int, obs int, ll double")
    assert rows(st.total_log_likelihood(df), "draw", "total_ll") == [(0, -3.0), (1, -4.0)]
    assert tuple(st.count_distincts(df, {"variable": "a", "draw": "b"}).first()) == (2, 2)


def test_binned_density_is_within_its_bound(spark):
    rnd = random.Random(2)
    data = [("a", rnd.gauss(0, 1)) for _ in range(3000)] + [("b", rnd.choice([1.0, 2.0, 50.0])) for _ in range(500)] + [("c", 1.0), ("c", 1.0), ("d", None)]
    df = spark.createDataFrame(data, "g string, v double")
    for per_bandwidth in (2, 32):
        exact = {(r.g, r.i): r for r in st.density(df, "v", ["g"], 50).collect()}
        got = st.binned_density(df, "v", ["g"], 50, per_bandwidth=per_bandwidth).collect()
        assert {(r.g, r.i) for r in got} == set(exact) and {r.g for r in got} == {"a", "b"}
        assert all(abs(r.density - exact[r.g, r.i].density) <= r.max_error + 1e-12 and r.x == pytest.approx(exact[r.g, r.i].x) for r in got)
    whole = st.binned_density(df.where("g = 'a'"), "v", [], 50)
    assert "_all" not in whole.columns and whole.count() == 50
    assert st.binned_density(df.where("false"), "v", ["g"], 50).count() == 0
