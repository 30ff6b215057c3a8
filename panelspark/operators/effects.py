"""Summaries of posterior draws and the reported effect sizes.

Draws come either as one row per (chain, draw) with an array per parameter, or
long as (chain, draw, idx, value). The draw table is the large one: every step
below aggregates it by observation or by sample in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions import codes
from panelspark.functions.nulls import ratio, weighted_mean
from panelspark.operators.panel import expand_dates, interpolate, rate_of_change
from panelspark.operators.stats import change_between, highest_density, interval_summary, quantiles, weighted_means
from panelspark.session import cut_lineage

# Fixed values of the effect-size report.
NATION = 337_000_000
STEPS = 24
DAYS_PER_STEP = 8
CASE_EFFICACY = 0.937
DEATH_EFFICACY = 0.94


def explode_draws(draws: DataFrame, array: str, idx: str = "idx", value: str = "value") -> DataFrame:
    """Array column to one row per element, numbered from 0."""
    rest = [c for c in draws.columns if c != array]
    return draws.select(*rest, F.posexplode(array).alias(idx, value))


def sample_id(n_draws: Column) -> Column:
    return F.col("chain") * n_draws + F.col("draw")


def posterior_mean(long: DataFrame, by: Sequence[str] = ("idx",), value: str = "value") -> DataFrame:
    """Mean over chains and draws."""
    return long.groupBy(*by).agg(F.avg(value).alias("mean"))


def posterior_summary(long: DataFrame, by: Sequence[str] = ("idx",), value: str = "value", prob: float = 0.9) -> DataFrame:
    """Mean, standard deviation, median, narrowest interval and r-hat per parameter element.

    r-hat compares the spread within chains with the spread of chain means;
    both come from one aggregate per (element, chain).
    """
    by = list(by)
    chains = long.groupBy(*by, "chain").agg(F.avg(value).alias("_m"), F.var_samp(value).alias("_v"), F.count(value).alias("_n"))
    between = chains.groupBy(*by).agg(F.avg("_v").alias("_w"), F.var_samp("_m").alias("_b"), F.avg("_n").alias("_n"))
    n = F.col("_n")
    r_hat = F.sqrt(ratio((n - 1) / n * F.col("_w") + F.col("_b"), F.col("_w")))
    basic = long.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    basic = basic.join(quantiles(long, value, [0.5], by).select(*by, F.col("value").alias("median")), by)
    hdi = highest_density(long, value, by, ["chain", "draw"], prob)
    return basic.join(hdi, by).join(between.select(*by, r_hat.alias("r_hat")), by)


def causal_rows(draws: DataFrame, panel: DataFrame, n_regions: Column | int, nu_width: int, n_draws: Column | int, times_population: bool = True) -> DataFrame:
    """One row per posterior sample and panel row, from draws with arrays ``A`` and ``nu`` and a scalar ``gamma_e``.

    ``panel`` has obs (row number in (t, region) order), t, region, N, S_tlag1
    and E_tlag1. The scalars of a draw travel with its exploded array, so the
    only join is the one with the panel on obs. A one day back is blended from
    the same region one step (``n_regions`` places) earlier; the first step has
    none and goes.
    """
    n_regions = F.lit(n_regions) if isinstance(n_regions, int) else n_regions
    n_draws = F.lit(n_draws) if isinstance(n_draws, int) else n_draws
    k, rest = n_regions, F.size("A") - n_regions
    # blended while still an array, so that the exploded rows carry scalars only
    blended = F.zip_with(F.slice("A", k + 1, rest), F.slice("A", F.lit(1), rest), codes.blend_lag1)
    rows = draws.select(sample_id(n_draws).alias("s"), "gamma_e", "nu", k.alias("_k"), F.posexplode(blended).alias("_i", "A_tlag1"))
    obs = F.col("_i") + F.col("_k")
    bin_of = F.floor(F.floor(obs / F.col("_k")) / nu_width).cast("int")
    slim = rows.select("s", "gamma_e", obs.cast("bigint").alias("obs"), "A_tlag1", F.get("nu", bin_of).alias("nu"))
    s_count = F.col("S_tlag1") * F.col("N") if times_population else F.col("S_tlag1")
    return slim.join(panel, "obs").select("s", "obs", "t", "region", "A_tlag1", "nu", "gamma_e", s_count.alias("S_tlag1"), "E_tlag1", "N")


def effect_per_sample(rows: DataFrame, nation: float = NATION, steps: int = STEPS, days: int = DAYS_PER_STEP) -> DataFrame:
    """(s, ate, delta_v): the population-weighted effect of exposure and the national total it implies.

    The total is the weighted mean of ATE * E / N over the rows, and as the
    weight is N this is ATE * sum(E) / sum(N): one aggregate per sample.
    """
    term = -(F.col("nu") * F.col("S_tlag1") * F.col("gamma_e") * (1 - F.col("A_tlag1"))) / F.col("N")
    sums = rows.groupBy("s").agg(
        weighted_mean(term, F.col("N").cast("double")).alias("ate"),
        ratio(F.sum("E_tlag1").cast("double"), F.sum("N")).alias("_e"),
    )
    return sums.select("s", "ate", (F.col("ate") * F.col("_e") * float(nation) * steps * days).alias("delta_v"))


def effect_distribution(samples: DataFrame, cols: Sequence[str] = ("ate", "delta_v")) -> DataFrame:
    """Mean, 95% interval and one-sided p-value over the posterior samples, per quantity.

    The samples, one row each, are stored: their intervals take more than one scan.
    """
    long = cut_lineage(samples.select("s", *cols)).unpivot(["s"], list(cols), "quantity", "value")
    return interval_summary(long, "value", ["quantity"], tail="upper").select("quantity", "n", "mean", "lower", "upper", "p", "sem")


def counterfactual_change(
    factual: DataFrame,
    counterfactual: DataFrame,
    panel: DataFrame,
    value: str,
    n_steps: Column,
    days: int = DAYS_PER_STEP,
    nation: float = NATION,
) -> DataFrame:
    """Difference of two simulated tables (chain, draw, obs, value) as a national total.

    Averaged over draws per obs, divided by N, averaged over regions by
    population per date, then over dates, times days covered and people.
    """
    keys = ["chain", "draw", "obs"]
    both = factual.select(*keys, F.col(value).alias("_f")).join(counterfactual.select(*keys, F.col(value).alias("_c")), keys)
    per_obs = both.groupBy("obs").agg(F.avg(F.col("_c") - F.col("_f")).alias("_d"))
    rows = per_obs.join(panel.select("obs", "date", "N"), "obs").withColumn("per_head", ratio(F.col("_d"), F.col("N")))
    daily = weighted_means(rows.withColumn("N", F.col("N").cast("double")), ["per_head"], "N", ["date"])
    out = daily.agg(F.avg("per_head").alias("per_head_per_day"))
    return out.select("per_head_per_day", (F.col("per_head_per_day") * days * n_steps).alias("per_head"),
                      (F.col("per_head_per_day") * days * n_steps * float(nation)).alias("total"))


def national_risk(
    panel: DataFrame,
    sentiment: DataFrame,
    case_efficacy: float = CASE_EFFICACY,
    death_efficacy: float = DEATH_EFFICACY,
) -> DataFrame:
    """Daily chance of a case and a death among the unprotected, and the expected counts.

    ``panel`` holds daily region rows with V, C, D and population, ``sentiment``
    sparse (region, date, A). A is interpolated to every panel date in its
    range and averaged by population.
    """
    full = interpolate(expand_dates(panel.select("region", "date", "population"), sentiment), "A")
    share = weighted_means(full.withColumn("population", F.col("population").cast("double")), ["A"], "population", ["date"])
    totals = national_daily_totals(panel).join(share, "date").withColumn("_nation", F.lit(0))
    daily = rate_of_change(totals, ["C", "D"], region="_nation").drop("_nation")
    n, v, c = F.col("N"), F.col("V"), F.col("C")
    daily = daily.withColumns(
        {
            "p_case": codes.risk_unprotected(F.col("C_dxdt1"), n, v, c, case_efficacy),
            "p_death": codes.risk_unprotected(F.col("D_dxdt1"), n, v, c, death_efficacy),
        }
    )
    s = n - (v + c)
    return daily.withColumns(
        {
            "cases_unprotected": F.col("p_case") * (n - c - v),
            "deaths_unprotected": F.col("p_death") * (n - c - v),
            "cases_unprotectable": F.col("p_case") * s * F.col("A"),
            "deaths_unprotectable": F.col("p_death") * s * F.col("A"),
        }
    )


def national_daily_totals(panel: DataFrame) -> DataFrame:
    return panel.groupBy("date").agg(
        F.sum("V").cast("double").alias("V"), F.sum("C").cast("double").alias("C"),
        F.sum("D").cast("double").alias("D"), F.sum("population").cast("double").alias("N"),
    )


def risk_totals(daily: DataFrame, case_efficacy: float = CASE_EFFICACY, death_efficacy: float = DEATH_EFFICACY) -> DataFrame:
    """Totals and fractions over the observation window."""
    row = daily.agg(
        *[F.sum(c).alias(c) for c in ("cases_unprotected", "deaths_unprotected", "cases_unprotectable", "deaths_unprotectable")],
        F.sum("p_case").alias("total_p_case"), F.sum("p_death").alias("total_p_death"),
        F.sum("C_dxdt1").alias("_c"), F.sum("D_dxdt1").alias("_d"),
    )
    return row.withColumns(
        {
            "cases_preventable": F.col("cases_unprotected") * case_efficacy,
            "deaths_preventable": F.col("deaths_unprotected") * death_efficacy,
            "share_cases_unprotected": ratio(F.col("cases_unprotected"), F.col("_c")),
            "share_deaths_unprotected": ratio(F.col("deaths_unprotected"), F.col("_d")),
            "share_cases_unprotectable": ratio(F.col("cases_unprotectable"), F.col("cases_unprotected")),
            "share_deaths_unprotectable": ratio(F.col("deaths_unprotectable"), F.col("deaths_unprotected")),
        }
    ).drop("_c", "_d")


def attributable(totals: DataFrame, n_people: float, case_efficacy: float = CASE_EFFICACY, death_efficacy: float = DEATH_EFFICACY) -> DataFrame:
    """Cases and deaths expected among ``n_people`` more unprotected people, and the part protection would have avoided."""
    cases, deaths = F.col("total_p_case") * n_people, F.col("total_p_death") * n_people
    return totals.select(cases.alias("cases"), deaths.alias("deaths"),
                         (cases * case_efficacy).alias("cases_attributable"), (deaths * death_efficacy).alias("deaths_attributable"))


def state_shares(panel: DataFrame, sentiment: DataFrame, people: float = NATION / 1e6) -> DataFrame:
    """Population-weighted V and S x A by date. The product is taken of the two means, then scaled to people."""
    p = F.col("population")
    states = panel.select("region", "date", "population", ((p - F.col("C") - F.col("V")) / p).alias("S"), (F.col("V") / p).alias("V"))
    full = interpolate(expand_dates(states, sentiment), "A").withColumn("population", p.cast("double"))
    daily = weighted_means(full, ["V", "S", "A"], "population", ["date"])
    return daily.select("date", "V", (F.col("S") * F.col("A")).alias("SxA"), (F.col("S") * F.col("A") * people).alias("SxA_people"))


def national_totals(panel: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Totals by date with per-capita columns."""
    totals = panel.groupBy("date").agg(*[F.sum(c).cast("double").alias(c) for c in cols], F.sum("population").cast("double").alias("population"))
    full = totals.withColumns({f"{c}_per_capita": ratio(F.col(c), F.col("population")) for c in cols})
    return full


def national_change(panel: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Change of the national totals between the first and the last date."""
    totals = national_totals(panel, cols)
    first, last = panel.agg(F.min("date")).scalar(), panel.agg(F.max("date")).scalar()
    return change_between(totals, [*cols, *[f"{c}_per_capita" for c in cols]], first, last)


def daily_flow(panel: DataFrame, col: str) -> DataFrame:
    """Sum over regions of the daily rate of change."""
    rates = rate_of_change(panel.select("region", "date", col), [col])
    return rates.groupBy("date").agg(F.sum(f"{col}_dxdt1").alias("flow"))

