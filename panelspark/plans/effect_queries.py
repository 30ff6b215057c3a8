"""Queries on posterior draws and reported effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import effects as ef
from panelspark.plans import tables as tb
from panelspark.plans.registry import Out, query
from panelspark.plans.stats_queries import HDI_SQL


def dated(df):
    return df.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


_MEAN = Out(longs=("idx",), doubles=("mean",))


@query("e01_posterior_mean", _MEAN.sql(tb.DR, "SELECT idx, avg(value) AS mean FROM ld GROUP BY 1"))
def posterior_mean(spark, sf):
    return _MEAN.of(ef.posterior_mean(ef.explode_draws(tb.draws(spark, sf), "v")))


_ALONG = Out(longs=("region", "step"), doubles=("mean",))


@query(
    "j12_mean_by_panel_row",
    _ALONG.sql(tb.DR + tb.RG, "SELECT rg.region, step, avg(value) AS mean FROM ld JOIN (rg CROSS JOIN range(0, 3) t(step)) ON rg.region + 25 * step = ld.idx GROUP BY 1, 2"),
)
def mean_by_panel_row(spark, sf):
    """Posterior means attached to panel rows by an explicit observation number, never by row order."""
    steps = tb.regions(spark, sf).select("region", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("step"))
    obs = steps.withColumn("idx", F.col("region") + 25 * F.col("step"))
    return _ALONG.of(ef.posterior_mean(tb.long_draws(spark, sf)).join(obs, "idx"))


_POST = Out(longs=("idx",), doubles=("mean", "std", "median", "lower", "upper", "r_hat"))


@query(
    "e16_posterior_summary",
    _POST.sql(
        tb.DR
        + HDI_SQL.format(0.9)
        + """ch AS (SELECT idx, chain, avg(value) AS m, var_samp(value) AS v, count(*) AS n FROM ld GROUP BY 1, 2),
        rh AS (SELECT idx, sqrt(((avg(n) - 1) / avg(n) * avg(v) + var_samp(m)) / avg(v)) AS r_hat FROM ch GROUP BY 1),
        b AS (SELECT idx, avg(value) AS mean, stddev_samp(value) AS std, quantile_cont(value, 0.5) AS median FROM ld GROUP BY 1)""",
        "SELECT * FROM b JOIN hdi USING (idx) JOIN rh USING (idx)",
    ),
)
def posterior_summary(spark, sf):
    return _POST.of(ef.posterior_summary(tb.long_draws(spark, sf)))


# ---- effect of exposure over all draws ----

CAUSAL = (
    tb.DR
    + tb.AP
    + """
pan AS (SELECT CASE WHEN day(date) > 15 THEN 1 ELSE 0 END AS t, region, CASE WHEN day(date) > 15 THEN 25 ELSE 0 END + region AS obs, population AS N,
          sum(n_flagged) / CAST(sum(n_events) AS DOUBLE) AS S, sum(n_refs) AS E FROM ap GROUP BY 1, 2, 3, 4 HAVING sum(n_events) > 0),
cr AS (SELECT chain * 1000000 + draw AS s, pan.region, 0.5 + a.value - (a.value - z.value) / 8 AS A_tlag1, nu.value AS nu, g.value AS gamma_e, S * N AS S_tlag1, E, N
       FROM ld a JOIN ld z USING (chain, draw) JOIN ld nu USING (chain, draw) JOIN ld g USING (chain, draw) JOIN pan ON pan.obs = a.idx
       WHERE a.idx BETWEEN 25 AND 49 AND z.idx = a.idx - 25 AND nu.idx = 51 AND g.idx = 63),
eff0 AS (SELECT s, sum(-(nu * S_tlag1 * gamma_e * (1 - A_tlag1)) / N * N) / sum(N) AS ate, sum(E) / sum(N) AS e FROM cr GROUP BY 1),
eff AS (SELECT s, ate, ate * e * 337000000.0 * 24 * 8 AS delta_v FROM eff0),
"""
)


def causal_panel(spark, sf):
    """Two time steps of each region: the half-months before and after the fifteenth."""
    late = (F.dayofmonth("date") > 15).cast("int")
    p = tb.activity_panel(spark, sf).groupBy(late.alias("t"), "region", "population").agg(
        F.sum("n_flagged").alias("f"), F.sum("n_events").alias("n"), F.sum("n_refs").alias("E_tlag1")
    )
    return p.where("n > 0").select(
        (F.col("t") * 25 + F.col("region")).cast("bigint").alias("obs"), "t", "region", F.col("population").alias("N"),
        (F.col("f") / F.col("n")).alias("S_tlag1"), "E_tlag1",
    )


def causal_rows(spark, sf):
    d = tb.draws(spark, sf).select(
        "chain", "draw", F.transform(F.slice("v", 1, 50), lambda x: x + 0.5).alias("A"), F.slice("v", 51, 4).alias("nu"), F.get("v", F.lit(63)).alias("gamma_e")
    )
    return ef.causal_rows(d, causal_panel(spark, sf), 25, 1, 1_000_000)


_ROWS = Out(longs=("s", "region", "N", "E_tlag1"), doubles=("A_tlag1", "nu", "gamma_e", "S_tlag1"))


@query("j09_causal_rows", _ROWS.sql(CAUSAL, "SELECT s, region, N, E AS E_tlag1, A_tlag1, nu, gamma_e, S_tlag1 FROM cr"))
def every_causal_row(spark, sf):
    return _ROWS.of(causal_rows(spark, sf))


_EFF = Out(longs=("s",), doubles={"ate": 9, "delta_v": 0})


@query("e03_effect_per_sample", _EFF.sql(CAUSAL, "SELECT * FROM eff"))
def effect_per_sample(spark, sf):
    return _EFF.of(ef.effect_per_sample(causal_rows(spark, sf)))


_DIST = Out(longs=("n",), strings=("quantity",), doubles={"mean": 5, "lower": 5, "upper": 5, "p": 6, "sem": 5})
_DIST_SQL = (
    "SELECT '{0}' AS quantity, count(*) AS n, avg({0}) AS mean, quantile_cont({0}, 0.025) AS lower, quantile_cont({0}, 0.975) AS upper, "
    "(count(*) FILTER ({0} >= 0) + 1) / (count(*) + 1) AS p, stddev_samp({0}) / sqrt(count(*)) AS sem FROM sc"
)


@query("e04_effect_distribution", _DIST.sql(CAUSAL + "sc AS (SELECT ate, delta_v / 1e6 AS delta_v FROM eff),", _DIST_SQL.format("ate") + " UNION ALL " + _DIST_SQL.format("delta_v")))
def effect_distribution(spark, sf):
    """Mean, interval and p-value over the posterior samples; totals in millions."""
    eff = ef.effect_per_sample(causal_rows(spark, sf)).withColumn("delta_v", F.col("delta_v") / 1e6)
    return _DIST.of(ef.effect_distribution(eff))


_CF = Out(doubles={"per_head_per_day": 9, "per_head": 9, "total": 0})


@query(
    "e05_counterfactual_change",
    _CF.sql(
        tb.DR
        + tb.RG
        + """d AS (SELECT idx AS obs, avg(value * value - value) AS d FROM ld GROUP BY 1),
        p AS (SELECT region + 25 * k AS obs, k, population AS N FROM rg, range(0, 3) t(k)),
        w AS (SELECT k, sum(d / N * N) / sum(N) AS ph FROM d JOIN p USING (obs) GROUP BY 1)""",
        "SELECT avg(ph) AS per_head_per_day, avg(ph) * 8 * 3 AS per_head, avg(ph) * 8 * 3 * 337000000.0 AS total FROM w",
    ),
)
def counterfactual_change(spark, sf):
    """Two result tables, here the draws and their squares, as a national total over the three steps that the elements cover."""
    fact = tb.long_draws(spark, sf).withColumnRenamed("idx", "obs")
    counter = fact.withColumn("value", F.col("value") * F.col("value"))
    r = tb.regions(spark, sf).select("region", F.col("population").alias("N"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    panel = r.select((F.col("region") + 25 * F.col("k")).alias("obs"), F.col("k").alias("date"), "N")
    return _CF.of(ef.counterfactual_change(fact, counter, panel, "value", F.lit(3)))


# ---- national reports ----

SENT = (
    tb.SO
    + """
sen AS (SELECT region, date, price / 1000000 AS A FROM so WHERE day(date) = 1),
pop AS (SELECT region, date, population * 100 AS population, V, C, D FROM op),
ex AS (SELECT p.region, p.date, p.population, p.V, p.C, sen.A, row_number() OVER (PARTITION BY p.region ORDER BY p.date) AS i FROM pop p LEFT JOIN sen USING (region, date)
       WHERE p.date BETWEEN (SELECT min(date) FROM sen) AND (SELECT max(date) FROM sen) AND p.region IN (SELECT region FROM sen)),
kn AS (SELECT *, max(CASE WHEN A IS NOT NULL THEN i END) OVER (PARTITION BY region ORDER BY i) AS ia,
         min(CASE WHEN A IS NOT NULL THEN i END) OVER (PARTITION BY region ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ib FROM ex),
fl AS (SELECT kn.region, kn.date, kn.population, kn.V, kn.C, coalesce(kn.A, a.A + (b.A - a.A) * (kn.i - a.i) / (b.i - a.i)) AS A
       FROM kn LEFT JOIN ex a ON a.region = kn.region AND a.i = kn.ia LEFT JOIN ex b ON b.region = kn.region AND b.i = kn.ib),
"""
)
RISK = (
    tb.OP
    + SENT
    + """
am AS (SELECT date, CASE WHEN count(A) = count(*) THEN sum(A * population) / sum(population) END AS A FROM fl GROUP BY 1),
nt AS (SELECT date, CAST(sum(V) AS DOUBLE) AS V, CAST(sum(C) AS DOUBLE) AS C, CAST(sum(D) AS DOUBLE) AS D, CAST(sum(population) AS DOUBLE) AS N FROM pop GROUP BY 1),
nd AS (SELECT nt.*, am.A FROM nt JOIN am USING (date)),
nr AS (SELECT x.*, x.C - y.C AS dC, x.D - y.D AS dD FROM nd x JOIN nd y ON y.date + 1 = x.date),
np AS (SELECT *, (dC / (N - C)) / (V / (N - C) * (1 - 0.937) + (N - C - V) / (N - C)) AS p_case, (dD / (N - C)) / (V / (N - C) * (1 - 0.94) + (N - C - V) / (N - C)) AS p_death FROM nr),
rk AS (SELECT *, p_case * (N - C - V) AS cases_unprotected, p_death * (N - C - V) AS deaths_unprotected, p_case * (N - V - C) * A AS cases_unprotectable, p_death * (N - V - C) * A AS deaths_unprotectable FROM np),
rt AS (SELECT sum(cases_unprotected) AS cases_unprotected, sum(deaths_unprotected) AS deaths_unprotected, sum(cases_unprotectable) AS cases_unprotectable, sum(deaths_unprotectable) AS deaths_unprotectable,
         sum(p_case) AS total_p_case, sum(p_death) AS total_p_death, sum(cases_unprotected) * 0.937 AS cases_preventable, sum(deaths_unprotected) * 0.94 AS deaths_preventable,
         sum(cases_unprotected) / sum(dC) AS share_cases_unprotected, sum(deaths_unprotected) / sum(dD) AS share_deaths_unprotected,
         sum(cases_unprotectable) / sum(cases_unprotected) AS share_cases_unprotectable, sum(deaths_unprotectable) / sum(deaths_unprotected) AS share_deaths_unprotectable FROM rk),
"""
)


def national_panel(spark, sf):
    return tb.order_panel(spark, sf).withColumn("population", F.col("population") * 100)


def sentiment(spark, sf):
    return tb.sparse_orders(spark, sf).where("day(date) = 1").select("region", "date", (F.col("price") / 1_000_000).alias("A"))


def risk(spark, sf):
    return ef.national_risk(national_panel(spark, sf), sentiment(spark, sf))


_DAILY = Out(strings=("date",), doubles={"p_case": 9, "p_death": 9, "cases_unprotected": 5, "deaths_unprotected": 5, "cases_unprotectable": 5, "deaths_unprotectable": 5})


@query("e07_national_risk", _DAILY.sql(RISK, "SELECT strftime(date, '%Y-%m-%d') AS date, p_case, p_death, cases_unprotected, deaths_unprotected, cases_unprotectable, deaths_unprotectable FROM rk"))
def national_risk(spark, sf):
    return _DAILY.of(dated(risk(spark, sf)))


_TOTALS = [
    "cases_unprotected", "deaths_unprotected", "cases_unprotectable", "deaths_unprotectable", "total_p_case", "total_p_death", "cases_preventable", "deaths_preventable",
    "share_cases_unprotected", "share_deaths_unprotected", "share_cases_unprotectable", "share_deaths_unprotectable",
]
_RT = Out(doubles={c: 5 for c in _TOTALS})


@query("e07_risk_totals", _RT.sql(RISK, "SELECT * FROM rt"))
def risk_totals(spark, sf):
    return _RT.of(ef.risk_totals(risk(spark, sf)))


_ATT = Out(doubles={c: 3 for c in ("cases", "deaths", "cases_attributable", "deaths_attributable")})


@query(
    "e08_attributable",
    _ATT.sql(RISK, "SELECT total_p_case * 285117 AS cases, total_p_death * 285117 AS deaths, total_p_case * 285117 * 0.937 AS cases_attributable, total_p_death * 285117 * 0.94 AS deaths_attributable FROM rt"),
)
def attributable(spark, sf):
    return _ATT.of(ef.attributable(ef.risk_totals(risk(spark, sf)), 285_117))


_FLOW = Out(strings=("date",), doubles=("flow",))


@query(
    "e12_daily_flow",
    _FLOW.sql(tb.OP, "SELECT strftime(op.date, '%Y-%m-%d') AS date, sum(op.U - a.U) AS flow FROM op JOIN op a ON a.region = op.region AND a.date + 1 = op.date GROUP BY op.date"),
)
def daily_flow(spark, sf):
    return _FLOW.of(dated(ef.daily_flow(tb.order_panel(spark, sf), "U")))


_STATES = Out(strings=("date",), doubles={"V": 8, "SxA": 8, "SxA_people": 5})


@query(
    "e13_state_shares",
    _STATES.sql(
        tb.OP
        + SENT
        + """sh AS (SELECT date, sum(V / population * population) / sum(population) AS V, sum((population - C - V) / population * population) / sum(population) AS S,
              CASE WHEN count(A) = count(*) THEN sum(A * population) / sum(population) END AS A FROM fl GROUP BY 1)""",
        "SELECT strftime(date, '%Y-%m-%d') AS date, V, S * A AS SxA, S * A * 337 AS SxA_people FROM sh",
    ),
)
def state_shares(spark, sf):
    return _STATES.of(dated(ef.state_shares(national_panel(spark, sf), sentiment(spark, sf))))


_NC = Out(doubles=("V", "C", "D", "V_per_capita", "C_per_capita", "D_per_capita"))


@query(
    "e14_national_change",
    _NC.sql(
        tb.OP + "nt AS (SELECT date, sum(V) AS V, sum(C) AS C, sum(D) AS D, sum(population) AS N FROM op GROUP BY 1), a AS (SELECT * FROM nt ORDER BY date LIMIT 1), b AS (SELECT * FROM nt ORDER BY date DESC LIMIT 1)",
        "SELECT b.V - a.V AS V, b.C - a.C AS C, b.D - a.D AS D, b.V / b.N - a.V / a.N AS V_per_capita, b.C / b.N - a.C / a.N AS C_per_capita, b.D / b.N - a.D / a.N AS D_per_capita FROM a, b",
    ),
)
def national_change(spark, sf):
    return _NC.of(ef.national_change(tb.order_panel(spark, sf), ["V", "C", "D"]))
