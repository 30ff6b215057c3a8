import random

import numpy as np
import pytest
from conftest import d, rows
from pyspark.sql import functions as F

from panelspark.operators import panel as pn


def panel(spark, values, start=0):
    """{region: [values]} with None for a present row without a value and 'gap' for no row."""
    data = [(r, d(start + i), v) for r, vs in values.items() for i, v in enumerate(vs) if v != "gap"]
    return spark.createDataFrame(data, "region int, date date, x double").repartition(3)


def series(df, col="x"):
    out = {}
    for r in df.orderBy("region", "date").collect():
        out.setdefault(r.region, []).append(r[col])
    return out


def test_lag_drops_rows_without_the_day_and_keeps_null_values(spark):
    p = panel(spark, {1: [1.0, None, 3.0, "gap", 5.0, 6.0]})
    got = pn.calendar_lag(p, ["x"], [1])
    assert [tuple(r) for r in got.orderBy("date").select("date", "x", "x_tlag1").collect()] == [(d(1), None, 1.0), (d(2), 3.0, None), (d(5), 6.0, 5.0)]


def test_lag_equals_self_join(spark):
    rnd = random.Random(2)
    p = panel(spark, {r: [float(rnd.randrange(50)) if rnd.random() > 0.2 else "gap" for _ in range(40)] for r in range(5)})
    got = pn.calendar_lag(p, ["x"], [1, 3], suffix="_s")
    want = p
    for n in (1, 3):
        moved = p.select("region", F.date_add("date", n).alias("date"), F.col("x").alias(f"x_tlag{n}_s"))
        want = want.join(moved, ["region", "date"])
    cols = ["region", "date", "x", "x_tlag1_s", "x_tlag3_s"]
    assert rows(got, *cols) == rows(want, *cols)


def test_lag_drop_removes_the_columns(spark):
    assert pn.calendar_lag(panel(spark, {1: [1.0, 2.0]}), ["x"], [1], drop=True).columns == ["region", "date", "x_tlag1"]


def test_repeated_day_raises(spark):
    p = panel(spark, {1: [1.0, 2.0]})
    with pytest.raises(Exception, match="two rows on one date"):
        pn.calendar_lag(p.union(p), ["x"], [1]).collect()
    with pytest.raises(Exception, match="not unique"):
        pn.require_unique(p.union(p), ["region", "date"]).collect()
    assert pn.require_unique(p, ["region", "date"]).count() == 2


def test_many_lags_share_one_exchange(spark):
    p = panel(spark, {1: [1.0] * 30})
    out = pn.calendar_lag(p, ["x"], list(range(2, 21)))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning(region") == 1


def test_rate_of_change(spark):
    got = pn.rate_of_change(panel(spark, {1: [float(i * i) for i in range(10)]}), ["x"], [1, 8])
    assert [(r.x, r.x_dxdt1, r.x_dxdt8) for r in got.orderBy("date").collect()] == [(64.0, 15.0, 8.0), (81.0, 17.0, 10.0)]


def test_is_monotonic(spark):
    p = panel(spark, {1: [1.0, 1.0, 2.0], 2: [2.0, 1.0], 3: [None, 1.0], 4: [5.0], 5: [1.0, None]})
    assert dict(pn.is_monotonic(p, ["x"]).collect()) == {1: True, 2: False, 3: False, 4: True, 5: False}


def repaired(x, eps, last):
    """Neighbour by neighbour; comparisons with a missing value are false."""
    x = [float("nan") if v is None else v for v in x]
    order = range(len(x) - 2, -1, -1) if last else range(1, len(x))
    for i in order:
        near = x[i + 1] if last else x[i - 1]
        fits = x[i] < near if last else x[i] > near
        x[i] = x[i] if fits else (near - eps if last else near + eps)
    return [None if v != v else v for v in x]


@pytest.mark.parametrize("last", [True, False])
@pytest.mark.parametrize("eps", [0.0, 1e-5, 0.5])
def test_make_monotonic_against_the_plain_loop(spark, eps, last):
    rnd = random.Random(3)
    values = {r: [None if rnd.random() < 0.1 else float(rnd.randrange(6)) + rnd.choice([0, 0.3]) for _ in range(25)] for r in range(12)}
    values[50] = [3.0]
    values[51] = [1.0, 2.0, None]
    got = series(pn.make_monotonic(panel(spark, values), ["x"], eps, last))
    for r, v in values.items():
        assert got[r] == pytest.approx(repaired(v, eps, last), nan_ok=True), (r, v)


def test_value_inside_epsilon_is_kept(spark):
    assert series(pn.make_monotonic(panel(spark, {1: [0.95, 1.0, 1.0]}), ["x"], 0.1))[1] == pytest.approx([0.8, 0.9, 1.0])
    assert series(pn.make_monotonic(panel(spark, {1: [0.85, 1.0, 1.0]}), ["x"], 0.1))[1] == pytest.approx([0.85, 0.9, 1.0])


@pytest.mark.parametrize("window, order", [(5, 1), (7, 2), (6, 3), (9, 1)])
def test_smoothing_reproduces_polynomials(spark, window, order):
    values = {1: [sum((i / 3) ** p for p in range(order + 1)) for i in range(20)]}
    got = series(pn.smooth(panel(spark, values), ["x"], window, order))[1]
    assert got == pytest.approx(values[1])


def test_smoothing_fits_each_window(spark):
    rnd = random.Random(4)
    x = [rnd.random() for _ in range(15)]
    got = series(pn.smooth(panel(spark, {1: x}), ["x"], 5, 2))[1]
    for i, g in enumerate(got):
        start = min(max(i - 2, 0), len(x) - 5)
        fit = np.polyfit(range(5), x[start : start + 5], 2)
        assert g == pytest.approx(np.polyval(fit, i - start))


def test_smoothing_edges(spark):
    p = panel(spark, {1: [1.0, 5.0, 2.0]})
    assert series(pn.smooth(p, ["x"], 1))[1] == [1.0, 5.0, 2.0]
    with pytest.raises(Exception, match="shorter than the smoothing window"):
        pn.smooth(p, ["x"], 5).collect()
    long = panel(spark, {1: [float(i) for i in range(20)]})
    assert series(pn.smooth(long, ["x"], 4, drop_ends=True))[1] == pytest.approx([float(i) for i in range(5, 15)])


def test_interpolation_by_position_and_date(spark):
    p = panel(spark, {1: [None, 0.0, None, "gap", "gap", 4.0, None]})
    assert series(pn.interpolate(p, "x"))[1] == [None, 0.0, 2.0, 4.0, None]
    assert series(pn.interpolate(p, "x", by="date"))[1] == [None, 0.0, 1.0, 4.0, None]
    with pytest.raises(Exception, match="cannot be interpolated"):
        pn.interpolate(p, "x", edges="raise").collect()


def test_interpolation_of_nothing(spark):
    assert series(pn.interpolate(panel(spark, {1: [None, None]}), "x"))[1] == [None, None]


def test_fill_calendar(spark):
    p = panel(spark, {1: [1.0, "gap", 3.0], 2: ["gap", 2.0]})
    regions = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "region int, population int")
    got = pn.fill_calendar(p, regions, ["x"])
    assert series(got) == {1: [1.0, 0.0, 3.0], 2: [0.0, 2.0, 0.0], 3: [0.0, 0.0, 0.0]}
    assert "population" in got.columns


def test_expand_dates(spark):
    p = panel(spark, {1: [1.0] * 6, 2: [2.0] * 6})
    sparse = spark.createDataFrame([(1, d(1), 10.0), (1, d(3), 30.0)], "region int, date date, a double")
    got = pn.interpolate(pn.expand_dates(p, sparse), "a")
    assert [(r.date, r.a) for r in got.orderBy("date").collect()] == [(d(1), 10.0), (d(2), 20.0), (d(3), 30.0)]


def test_thinning_takes_the_earliest_of_the_kept_dates(spark):
    # 200 dates, the median is 0 on the first ten
    p = panel(spark, {r: [0.0] * 10 + [1.0] * 190 for r in (1, 2, 3)})
    got = [r.date for r in pn.thin_dates(p, "x", n=5).where("region = 1").orderBy("date").collect()]
    back = [d(199 - 8 * i) for i in range(100) if 199 - 8 * i >= 10]
    assert got == sorted(back)[:5]
    cut = pn.thin_dates(p, "x", n=5, before=str(sorted(back)[3]))
    assert cut.select("date").distinct().count() == 3


def test_time_index_and_step_parameter(spark):
    p = panel(spark, {1: [1.0, "gap", 2.0, 3.0], 2: [4.0]})
    t = pn.time_index(p)
    assert rows(t, "region", "date", "t") == [(1, d(0), 0), (1, d(2), 1), (1, d(3), 2), (2, d(0), 0)]
    values = spark.createDataFrame([(0, 0.5), (1, 0.7)], "bin int, nu double")
    assert rows(pn.step_parameter(t, values, 2, "nu"), "region", "t", "nu") == [(1, 0, 0.5), (1, 1, 0.5), (1, 2, 0.7), (2, 0, 0.5)]


def test_saturating_accumulation_equals_the_loop(spark):
    rnd = random.Random(5)
    gains = {r: [rnd.uniform(-0.05, 0.2) for _ in range(12)] for r in range(6)}
    gains[9] = [0.1, 0.125, 0.05]  # 1 - 8 * 0.125 = 0
    p = panel(spark, gains).withColumn("a0", F.col("region") / 20)
    got = series(pn.saturating_accumulation(p, "a0", "x"), "A")
    for r, g in gains.items():
        a, want = r / 20, [r / 20]
        for v in g[1:]:
            a = a + 8 * v * (1 - a)
            want.append(a)
        assert got[r] == pytest.approx(want)


def test_compartments_and_interactions(spark):
    p = panel(spark, {1: [float(i) for i in range(10)]}).withColumns(
        {"population": F.lit(100), "v": F.lit(20.0), "dd": F.lit(1.0), "f": F.lit(3.0), "A": F.lit(0.25)}
    )
    got = pn.interactions(pn.compartments(p, vaccinated="v", deaths="dd", cases="x", produced="f")).orderBy("date").collect()
    assert [(r.C, r.R, r.I, r.S) for r in got] == [(8.0, 0.0, 8.0, 72.0), (9.0, 1.0, 8.0, 71.0)]
    assert (got[0].SxI, got[0]["Sx1mA"], got[0]["1mA"], got[0].const) == (576.0, 54.0, 0.75, 1)


def test_balance_and_complete_regions(spark):
    p = panel(spark, {1: [1.0, 2.0], 2: [1.0, "gap"], 3: [4.0, 5.0]})
    assert pn.balance(p).first().balanced is False
    kept = pn.complete_regions(p)
    assert pn.balance(kept).first().balanced is True
    assert {r.region for r in kept.collect()} == {1, 3}


def test_clusters(spark):
    df = spark.createDataFrame([(1, 5, 0, 1.0), (2, 5, 0, 3.0), (3, 7, 0, 9.0), (1, 5, 1, 2.0), (2, 5, 1, 4.0), (3, 7, 1, 8.0)], "region int, cluster int, t int, x double")
    assert rows(pn.cluster_profiles(df, ["x"]), "cluster", "share", "x") == [(5, pytest.approx(2 / 3), 3.0), (7, pytest.approx(1 / 3), 8.0)]
    assert {(r.region, r.cluster) for r in pn.relabel_clusters(df).collect()} == {(1, 0), (2, 0), (3, 1)}


def test_scaled_profile_and_totals(spark):
    p = panel(spark, {1: [-4.0, 2.0], 2: [0.0, 0.0]}).withColumn("population", F.lit(2))
    assert series(pn.scaled_profile(p, ["x"])) == {1: [-1.0, 0.5], 2: [None, None]}
    t = pn.total_over_time(panel(spark, {1: [4.0, 4.0], 2: [0.0]}).withColumn("population", F.lit(2)), "x", "all")
    assert {(r.region, r["all"], r.all_per_capita, r.all_per_capita_log) for r in t.collect()} == {(1, 8.0, 4.0, 2.0), (2, 0.0, 0.0, None)}
