import random

import numpy as np
import pytest
from conftest import d, rows
from pyspark.sql import functions as F

from panelspark.operators import effects as ef
from panelspark.operators import model as md
from panelspark.operators import sampling as sm


def test_consensus(spark):
    df = spark.createDataFrame([(1, 1, 1, 1), (2, 1, 1, 3), (3, 1, 2, 3), (4, None, None, 1), (5, 2, 2, 2)], "id int, rating1 int, rating2 int, rating3 int")
    assert rows(md.consensus(df), "id", "label", "is_flagged") == [(1, 1.0, True), (5, 2.0, False)]
    assert rows(md.consensus(df, "any2"), "id", "is_flagged") == [(1, True), (2, True), (5, False)]


def auc(pos, neg):
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]) if pos and neg else None


def test_metrics(spark):
    data = [("a", 1, 0.9, 1), ("a", 0, 0.9, 2), ("a", 1, 0.5, 3), ("a", 0, 0.1, 4), ("b", 1, 0.3, 1), ("b", 1, 0.2, 1), ("c", 0, 0.1, 1)]
    df = spark.createDataFrame(data, "g string, label int, score double, weight int")
    got = {r.g: r for r in md.confusion_metrics(df, ["g"]).collect()}
    a = got["a"]  # tp 1, fp 2, fn 3, tn 4; a score of exactly 0.5 is not a hit
    assert (a.accuracy, a.precision, a.recall, a.f1) == (0.5, pytest.approx(1 / 3), 0.25, pytest.approx(2 / 7))
    assert a.mcc == pytest.approx((1 * 4 - 2 * 3) / (3 * 4 * 6 * 7) ** 0.5)
    assert (got["b"].precision, got["b"].recall, got["b"].f1, got["b"].mcc) == (0, 0, 0, 0)
    curve = {r.g: r.auroc for r in md.roc_auc(df, ["g"]).collect()}
    assert curve["a"] == pytest.approx(auc([0.9, 0.5, 0.5, 0.5], [0.9, 0.9, 0.1, 0.1, 0.1, 0.1]))
    assert curve["b"] is None and curve["c"] is None


@pytest.mark.parametrize("exact", [True, False])
def test_bootstrap_metrics(spark, exact):
    rnd = random.Random(1)
    df = spark.createDataFrame([(i, i % 2, min(1.0, max(0.0, rnd.gauss(0.35 + 0.3 * (i % 2), 0.2)))) for i in range(120)], "id int, label int, score double")
    reps = md.bootstrap_metrics(df, "id", 30, 3, exact=exact)
    assert reps.count() == 30
    table = {r.metric: r for r in md.metric_intervals(reps).collect()}
    assert set(table) == set(md.METRICS)
    assert 0.6 < table["accuracy"].mean < 0.95 and table["auroc"].half_width > 0


def test_text_classifier_learns_and_scores_each_text(spark):
    good = [f"fine calm day number{i % 5}" for i in range(30)]
    bad = [f"awful storm night number{i % 5}" for i in range(10)]
    df = spark.createDataFrame([(t, 0) for t in good] + [(t, 1) for t in bad], "text string, label int")
    w = rows(df.withColumn("w", md.class_weights(df)), "label", "w")
    assert w[0] == (0, 0.25) and w[-1] == (1, 0.75)
    model = md.train_text_classifier(df)
    got = rows(md.score_texts(spark.createDataFrame([("awful storm",), ("calm day",)], "text string"), model), "text", "label")
    assert got == [("awful storm", 1), ("calm day", 0)]


def test_model_of_two_sources_is_stored_and_evaluated(spark, tmp_path):
    """Scores of the stored model are those of the trained one, and its replicates are those of a plain draw from them."""
    own = spark.createDataFrame([(i, f"{'awful storm' if i % 3 == 0 else 'calm day'} number{i % 11}", int(i % 3 == 0)) for i in range(100)], "id int, text string, label int")
    other = spark.createDataFrame([(i, f"{'rain' if i % 2 else 'sun'} number{i % 7}", i % 2) for i in range(1000, 1090)], "id int, text string, label int")
    test, train = sm.split_by_count(own, "id", 30, 1)
    mix = md.training_mix(train, other, "id", 2)
    assert mix.where("id < 1000").count() == 70 and mix.where("id >= 1000").count() == 28
    assert md.training_mix(train, other, "id", 2, share=5.0).count() == 160
    model = md.train_text_classifier(mix)
    md.save_model(model, str(tmp_path / "model"))
    again = md.load_model(str(tmp_path / "model"))
    want = rows(md.held_out_scores(test, model, "id"), "id", "label", "score")
    assert rows(md.held_out_scores(test, again, "id"), "id", "label", "score") == want and len(want) == 30
    reps = md.bootstrap_metrics(md.held_out_scores(test, again, "id"), "id", 40, 3).collect()
    right = [(score > 0.5) == bool(label) for _, label, score in want]
    assert len(reps) == 40 and np.mean([r.accuracy for r in reps]) == pytest.approx(np.mean(right), abs=0.08)


def test_clusters(spark):
    data = [(r, d(t), (r % 2) * 10 + r * 0.01, (r % 2) * 5.0) for r in range(8) for t in range(2)]
    df = spark.createDataFrame(data, "region int, date date, a double, b double")
    got = {r.region: r.cluster for r in md.cluster_regions(df, ["a", "b"], 2, 1).collect()}
    assert len({got[r] for r in range(0, 8, 2)}) == len({got[r] for r in range(1, 8, 2)}) == 1 and got[0] != got[1]
    assert {r.cluster for r in md.cluster_regions(df, ["a", "b"], None).collect()} == set(range(8))
    pcs = md.principal_components(df, ["a", "b"], 2).collect()
    assert np.mean([r.pc0 for r in pcs]) == pytest.approx(0, abs=1e-9)


def test_ols(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(60, 2))
    y = 3 + x @ np.array([2.0, -1.0]) + rnd.normal(size=60)
    df = spark.createDataFrame([(i, float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(60)], "id int, y double, a double, b double")
    plain = md.ols_by_replicate(df.withColumns({"rep": F.lit(0), "weight": F.lit(1)}), "y", ["a", "b"])
    design = np.column_stack([np.ones(60), x])
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    got = {r.feature: r for r in plain.collect()}
    assert (got["a"].coef, got["b"].coef) == (pytest.approx(beta[1]), pytest.approx(beta[2]))
    resid = y - design @ beta
    assert got["a"].explained_variance == pytest.approx(1 - resid.var() / y.var())
    report = {r.feature: r for r in md.ols_report(df, "y", ["a", "b"]).collect()}
    cov = np.linalg.inv(design.T @ design) * (resid @ resid) / 57
    assert report["const"].coef == pytest.approx(beta[0]) and report["a"].std_error == pytest.approx(cov[1, 1] ** 0.5)
    assert report["b"].t == pytest.approx(beta[2] / cov[2, 2] ** 0.5) and report["a"].r2 == pytest.approx(1 - resid.var() / y.var())
    summary = md.coefficient_summary(md.bootstrap_ols(df, "id", "y", ["a", "b"], 40, 3)).collect()
    assert [r.feature for r in summary] == ["a", "b"] and summary[0].p == pytest.approx(1 / 41)
    assert summary[0].mean_text == f"{summary[0].mean:.5f}"


def test_forest(spark):
    rnd = random.Random(3)
    df = spark.createDataFrame([(i, float(i % 7) * 3 + rnd.random(), float(i % 7), rnd.random()) for i in range(140)], "id int, y double, a double, b double")
    reps = md.forest_importances(df, "id", "y", ["a", "b"], 2, 5, trees=5)
    assert reps.count() == 4 and reps.agg(F.min("explained_variance")).first()[0] > 0.5
    assert md.importance_summary(reps).first().feature == "a"


# ---- effects ----


def test_causal_rows_and_effect_against_plain_loops(spark):
    rnd = np.random.default_rng(4)
    n_r, n_t, chains, draws_n = 3, 4, 2, 5
    A = rnd.random((chains, draws_n, n_t * n_r))
    nu = rnd.random((chains, draws_n, 2))
    g = rnd.random((chains, draws_n))
    post = spark.createDataFrame(
        [(c, k, A[c, k].tolist(), nu[c, k].tolist(), float(g[c, k])) for c in range(chains) for k in range(draws_n)],
        "chain int, draw int, A array<double>, nu array<double>, gamma_e double",
    )
    N, S, E = rnd.integers(10, 99, n_r), rnd.random((n_t, n_r)), rnd.random((n_t, n_r))
    panel = spark.createDataFrame(
        [(t * n_r + r, t, r, int(N[r]), float(S[t, r]), float(E[t, r])) for t in range(1, n_t) for r in range(n_r)],
        "obs long, t int, region int, N long, S_tlag1 double, E_tlag1 double",
    )
    rows_ = ef.causal_rows(post, panel, n_r, 2, draws_n)
    assert rows_.count() == chains * draws_n * (n_t - 1) * n_r
    got = {r.s: r for r in ef.effect_per_sample(rows_, nation=1000, steps=2, days=3).collect()}
    for c in range(chains):
        for k in range(draws_n):
            ate_num = dv = w = 0.0
            for t in range(1, n_t):
                for r in range(n_r):
                    a, b = A[c, k, t * n_r + r], A[c, k, (t - 1) * n_r + r]
                    a1 = a - (a - b) / 8
                    term = -(nu[c, k, t // 2] * S[t, r] * N[r] * g[c, k] * (1 - a1)) / N[r]
                    ate_num += term * N[r]
                    dv += E[t, r] / N[r] * N[r]
                    w += N[r]
            s = c * draws_n + k
            assert got[s].ate == pytest.approx(ate_num / w)
            assert got[s].delta_v == pytest.approx(ate_num / w * dv / w * 1000 * 2 * 3)
    dist = {r.quantity: r for r in ef.effect_distribution(ef.effect_per_sample(rows_)).collect()}
    assert dist["ate"].n == 10 and dist["ate"].p == pytest.approx(1 / 11)
    as_share = ef.causal_rows(post, panel, n_r, 2, draws_n, times_population=False)
    assert rows(as_share, "S_tlag1")[0][0] < 1


def test_posterior_summary(spark):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(3, 40))
    long = spark.createDataFrame([(c, k, 0, float(x[c, k])) for c in range(3) for k in range(40)], "chain int, draw int, idx int, value double")
    r = ef.posterior_summary(long).first()
    w, b = x.var(axis=1, ddof=1).mean(), x.mean(axis=1).var(ddof=1)
    assert r.r_hat == pytest.approx(((39 / 40 * w + b) / w) ** 0.5)
    assert (r.mean, r.median) == (pytest.approx(x.mean()), pytest.approx(np.median(x)))
    assert ef.posterior_mean(long).first()["mean"] == pytest.approx(x.mean())


def test_counterfactual_change(spark):
    f = spark.createDataFrame([(0, k, o, 1.0 * o) for k in range(2) for o in range(4)], "chain int, draw int, obs int, v double")
    c = f.withColumn("v", F.col("v") + F.col("draw"))  # mean difference 0.5 everywhere
    panel = spark.createDataFrame([(o, d(o // 2), 10 if o % 2 else 30) for o in range(4)], "obs int, date date, N int")
    r = ef.counterfactual_change(f, c, panel, "v", F.lit(2), days=8, nation=100).first()
    per_day = (0.5 / 30 * 30 + 0.5 / 10 * 10) / 40
    assert tuple(r) == (pytest.approx(per_day), pytest.approx(per_day * 16), pytest.approx(per_day * 1600))


def test_risk_reports(spark):
    panel = spark.createDataFrame([(r, d(t), 1000, 100 + 10 * t, 50 + 5 * t, 1 + t) for r in (1, 2) for t in range(5)], "region int, date date, population int, V int, C int, D int")
    sent = spark.createDataFrame([(r, d(t), a) for r in (1, 2) for t, a in ((0, 0.2), (4, 0.6))], "region int, date date, A double")
    daily = ef.national_risk(panel, sent)
    one = daily.orderBy("date").first()
    assert one.A == pytest.approx(0.3) and one.C_dxdt1 == 10
    n, v, c = 2000, 220, 110
    p = 10 / (n - c) / (v / (n - c) * (1 - 0.937) + (n - c - v) / (n - c))
    assert one.p_case == pytest.approx(p) and one.cases_unprotectable == pytest.approx(p * (n - v - c) * 0.3)
    t = ef.risk_totals(daily).first()
    assert t.share_cases_unprotected == pytest.approx(t.cases_unprotected / 40)
    att = ef.attributable(ef.risk_totals(daily), 100).first()
    assert att.cases == pytest.approx(100 * t.total_p_case) and att.deaths_attributable == pytest.approx(94 * t.total_p_death)
    s = ef.state_shares(panel, sent).orderBy("date").first()
    assert (s.V, s.SxA) == (pytest.approx(0.1), pytest.approx(0.85 * 0.2))
    ch = ef.national_change(panel, ["V"]).first()
    assert (ch.V, ch.V_per_capita) == (80.0, pytest.approx(0.04))
    assert [r.flow for r in ef.daily_flow(panel, "C").collect()] == [10.0] * 4
