"""Queries on summary statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions.nulls import sum0, weighted_mean
from panelspark.operators import stats as st
from panelspark.plans import tables as tb
from panelspark.plans.registry import Out, query


def dated(df):
    return df.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


KEYS = "region, strftime(date, '%Y-%m-%d') AS date"

_SUM = Out(longs=("l_suppkey", "n"), doubles={"quantity": 2, "mean_discount": 6})


@query("a07_sum_and_mean", _SUM.sql("", "SELECT l_suppkey, count(*) AS n, coalesce(sum(l_quantity), 0) AS quantity, avg(l_discount) AS mean_discount FROM lineitem GROUP BY 1"))
def sum_and_mean(spark, sf):
    line = tb.table(spark, sf, "lineitem")
    return _SUM.of(line.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), sum0(F.col("l_quantity")).alias("quantity"), F.avg("l_discount").alias("mean_discount")))


_MED = Out(longs=("region",), doubles={"value": 3})


@query("a09_median_per_group", _MED.sql("", "SELECT c_nationkey AS region, quantile_cont(CAST(o_totalprice AS DOUBLE), 0.5) AS value FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1"))
def median_per_group(spark, sf):
    return _MED.of(st.quantiles(tb.located_orders(spark, sf), "o_totalprice", [0.5], ["region"]))


_LAST = Out(longs=("region",), doubles={"first_price": 6, "last_price": 6})


@query(
    "a10_first_last_values",
    _LAST.sql(
        tb.SO + "g AS (SELECT region, date, CASE WHEN n % 3 = 0 THEN NULL ELSE price END AS p FROM so)",
        "SELECT region, arg_min(p, date) FILTER (p IS NOT NULL) AS first_price, arg_max(p, date) FILTER (p IS NOT NULL) AS last_price FROM g GROUP BY 1",
    ),
)
def first_last_values(spark, sf):
    """The last non-missing value, not the value of the last row."""
    s = tb.sparse_orders(spark, sf).withColumn("p", F.when(F.col("n") % 3 == 0, None).otherwise(F.col("price")))
    first = st.first_values(s, ["p"]).withColumnRenamed("p", "first_price")
    return _LAST.of(first.join(st.last_values(s, ["p"]).withColumnRenamed("p", "last_price"), "region"))


_WM = Out(strings=("date",), doubles=("V", "C"))


@query("a16_weighted_means", _WM.sql(tb.OP, "SELECT strftime(date, '%Y-%m-%d') AS date, sum(V * population) / sum(population) AS V, sum(C * population) / sum(population) AS C FROM op GROUP BY date"))
def weighted_means(spark, sf):
    p = tb.order_panel(spark, sf).withColumn("population", F.col("population").cast("double"))
    return _WM.of(dated(st.weighted_means(p, ["V", "C"], "population", ["date"])))


_WS = Out(longs=("region",), doubles={"strict": 6})


@query(
    "a15_weighted_mean_strict",
    _WS.sql(
        tb.SO + "g AS (SELECT region, n, CASE WHEN month(date) = 2 AND n = 3 THEN NULL ELSE price END AS p FROM so)",
        "SELECT region, CASE WHEN count(p) = count(*) THEN sum(p * n) / sum(n) END AS strict FROM g GROUP BY 1",
    ),
)
def weighted_mean_strict(spark, sf):
    """One missing value makes a group's weighted mean missing."""
    s = tb.sparse_orders(spark, sf)
    p = F.when((F.month("date") == 2) & (F.col("n") == 3), None).otherwise(F.col("price"))
    return _WS.of(s.groupBy("region").agg(weighted_mean(p, F.col("n").cast("double")).alias("strict")))


_Q = Out(strings=("l_returnflag",), doubles={"prob": 3, "value": 3})
PROBS = [0.025, 0.25, 0.5, 0.75, 0.975]


@query(
    "a17_quantiles",
    _Q.sql("", " UNION ALL ".join(f"SELECT l_returnflag, {p} AS prob, quantile_cont(l_extendedprice, {p}) AS value FROM lineitem GROUP BY 1" for p in PROBS)),
)
def quantiles(spark, sf):
    """Exact quantiles of a long column in three groups, without gathering a group."""
    return _Q.of(st.quantiles(tb.table(spark, sf, "lineitem"), "l_extendedprice", PROBS, ["l_returnflag"]))


@query(
    "a17_quantiles_all",
    _Q.sql("", " UNION ALL ".join(f"SELECT 'all' AS l_returnflag, {p} AS prob, quantile_cont(l_quantity * l_discount, {p}) AS value FROM lineitem" for p in PROBS)),
)
def quantiles_all(spark, sf):
    """The same over the whole table, for a column with many equal values."""
    line = tb.table(spark, sf, "lineitem").select((F.col("l_quantity") * F.col("l_discount")).alias("x"))
    return _Q.of(st.quantiles(line, "x", PROBS).withColumn("l_returnflag", F.lit("all")))


_INTV = Out(longs=("idx", "n"), doubles=("mean", "lower", "upper", "half_width", "p", "sem"))


@query(
    "a18_interval_summary",
    _INTV.sql(
        tb.DR
        + """s AS (SELECT idx, count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.025) AS lower, quantile_cont(value, 0.975) AS upper,
             stddev_samp(value) / sqrt(count(*)) AS sem, (count(*) FILTER (value <= 0) + 1) / (count(*) + 1) AS pl, (count(*) FILTER (value >= 0) + 1) / (count(*) + 1) AS pu FROM ld GROUP BY 1)""",
        "SELECT idx, n, mean, lower, upper, sem, CASE WHEN mean > 0 THEN pl ELSE pu END AS p, greatest(mean - lower, upper - mean) AS half_width FROM s",
    ),
)
def interval_summary(spark, sf):
    return _INTV.of(st.interval_summary(tb.long_draws(spark, sf), "value", ["idx"]))


_COR = Out(strings=("a", "b"), doubles=("corr",))
COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "a21_correlation_matrix",
    _COR.sql("", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM lineitem" for i, a in enumerate(COLS) for b in COLS[i + 1 :])),
)
def correlation_matrix(spark, sf):
    return _COR.of(st.correlation_matrix(tb.table(spark, sf, "lineitem"), COLS))


_SHR = Out(longs=("region", "population"), doubles=("share",))


@query("a22_shares", _SHR.sql(tb.RG, "SELECT region, population, population / sum(population) OVER () AS share FROM rg"))
def shares(spark, sf):
    return _SHR.of(st.shares(tb.regions(spark, sf), "population"))


_CHG = Out(longs=("V", "C", "D"))


@query(
    "a26_change_between_dates",
    _CHG.sql(
        tb.OP,
        "SELECT " + ", ".join(f"sum({c}) FILTER (date = DATE '2001-01-01') - sum({c}) FILTER (date = DATE '1996-01-01') AS {c}" for c in "VCD") + " FROM op",
    ),
)
def change_between_dates(spark, sf):
    p = tb.order_panel(spark, sf)
    return _CHG.of(st.change_between(p, ["V", "C", "D"], F.lit("1996-01-01").cast("date"), F.lit("2001-01-01").cast("date")))


_HIST = Out(longs=("bin", "n"))


@query(
    "a27_log_histogram",
    _HIST.sql("", "SELECT least(CAST(floor((log10(o_totalprice) - 2) / 0.08) AS INT), 49) AS bin, count(*) AS n FROM orders WHERE o_totalprice > 0 AND log10(o_totalprice) BETWEEN 2 AND 6 GROUP BY 1"),
)
def log_histogram(spark, sf):
    return _HIST.of(st.log_histogram(tb.table(spark, sf, "orders"), "o_totalprice", 2, 6, 50))


_HDI = Out(longs=("idx",), doubles=("lower", "upper"))
HDI_SQL = """
srt AS (SELECT idx, value, row_number() OVER (PARTITION BY idx ORDER BY value) - 1 AS i, CAST(floor(count(*) OVER (PARTITION BY idx) * {0}) AS BIGINT) AS k FROM ld),
hdi AS (SELECT a.idx, a.value AS lower, b.value AS upper FROM srt a JOIN srt b ON b.idx = a.idx AND b.i = a.i + a.k
        QUALIFY row_number() OVER (PARTITION BY a.idx ORDER BY b.value - a.value, a.value) = 1),
"""


@query("a28_highest_density", _HDI.sql(tb.DR + HDI_SQL.format(0.95), "SELECT idx, lower, upper FROM hdi"))
def highest_density(spark, sf):
    return _HDI.of(st.highest_density(tb.long_draws(spark, sf), "value", ["idx"], ["chain", "draw"]))


_KDE = Out(longs=("chain", "i"), doubles=("x", "density"))


@query(
    "a29_density_curve",
    _KDE.sql(
        "d AS (SELECT vec_id % 4 AS chain, list_sum(CAST(embedding AS DOUBLE[])) AS v FROM embeddings),"
        "s AS (SELECT chain, stddev_samp(v) * pow(count(*), -0.2) AS bw, min(v) AS a, max(v) AS b FROM d GROUP BY 1),"
        "g AS (SELECT s.chain, i, bw, a - 3 * bw + (b - a + 6 * bw) * i / 99 AS x FROM s, range(0, 100) t(i))",
        "SELECT g.chain, i, x, avg(exp(-0.5 * ((x - v) / bw) ** 2) / (bw * sqrt(2 * pi()))) AS density FROM g JOIN d ON d.chain = g.chain GROUP BY g.chain, i, x",
    ),
)
def density_curve(spark, sf):
    d = tb.draws(spark, sf).select("chain", F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("v"))
    return _KDE.of(st.density(d, "v", ["chain"], 100))


_BINNED = Out(longs=("chain", "i"), doubles=("x", "density", "max_error"))


@query(
    "a29_binned_density",
    _BINNED.sql(
        "d AS (SELECT vec_id % 4 AS chain, list_sum(CAST(embedding AS DOUBLE[])) AS v FROM embeddings),"
        "s AS (SELECT chain, stddev_samp(v) * pow(count(*), -0.2) AS bw, min(v) AS a, max(v) AS b FROM d GROUP BY 1),"
        "p AS (SELECT chain, (v - a) / bw * 32 AS z FROM d JOIN s USING (chain)),"
        "n AS (SELECT chain, floor(z) AS node, 1 - (z - floor(z)) AS w FROM p UNION ALL SELECT chain, floor(z) + 1, z - floor(z) FROM p),"
        "m AS (SELECT chain, node, sum(w) AS w FROM n GROUP BY 1, 2),"
        "g AS (SELECT s.chain, i, a, bw, a - 3 * bw + (b - a + 6 * bw) * i / 99 AS x FROM s, range(0, 100) t(i))",
        "SELECT g.chain, i, x, sum(w * exp(-0.5 * ((x - a - node * bw / 32) / bw) ** 2)) / sum(w) / (bw * sqrt(2 * pi())) AS density, "
        "1 / (8 * 32 * 32 * sqrt(2 * pi()) * bw) AS max_error FROM g JOIN m ON m.chain = g.chain GROUP BY g.chain, i, x, a, bw",
    ),
)
def binned_density_curve(spark, sf):
    d = tb.draws(spark, sf).select("chain", F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("v"))
    return _BINNED.of(st.binned_density(d, "v", ["chain"], 100))


_LL = Out(longs=("chain", "obs"), doubles=("total_ll",))


@query(
    "a30_total_log_likelihood",
    _LL.sql(tb.DR, "SELECT chain, obs, sum(ll) AS total_ll FROM (SELECT chain, draw, idx // 4 AS obs, -0.5 * value * value AS ll FROM ld) GROUP BY 1, 2"),
)
def total_log_likelihood(spark, sf):
    """Four outcome variables per observation, added up per draw and then per chain."""
    ll = tb.long_draws(spark, sf).select("chain", "draw", F.floor(F.col("idx") / 4).alias("obs"), (-0.5 * F.col("value") * F.col("value")).alias("ll"))
    per_draw = st.total_log_likelihood(ll)
    return _LL.of(per_draw.groupBy("chain", "obs").agg(F.sum("total_ll").alias("total_ll")))


_EVAR = Out(strings=("l_returnflag",), doubles=("explained",))


@query(
    "a31_explained_variance",
    _EVAR.sql("", "SELECT l_returnflag, 1 - var_pop(l_extendedprice - l_quantity * 1500) / var_pop(l_extendedprice) AS explained FROM lineitem GROUP BY 1"),
)
def explained_variance(spark, sf):
    line = tb.table(spark, sf, "lineitem")
    return _EVAR.of(line.groupBy("l_returnflag").agg(st.explained_variance(F.col("l_extendedprice"), F.col("l_quantity") * 1500).alias("explained")))


_SC = Out(longs=("user_id",), doubles=("z", "mm", "constant"))


@query(
    "m08_scaled_columns",
    _SC.sql("", "SELECT c_custkey AS user_id, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS z, "
                "(c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) AS mm, 0 AS constant FROM customer"),
)
def scaled_columns(spark, sf):
    c = tb.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("z"), F.col("c_acctbal").alias("mm"), F.lit(5.0).alias("constant"))
    return _SC.of(st.min_max_scaled(st.standard_scaled(c, ["z"]), ["mm", "constant"]))
