"""Queries on region-to-region networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import network as nw
from panelspark.operators import regions as rg
from panelspark.plans import tables as tb
from panelspark.plans.registry import Out, query
from panelspark.session import cut_lineage


def dated(df):
    return df.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


NET = tb.EV + tb.NW

_NET = Out(longs=("src", "dst", "n_refs"), doubles=("n_refs_per_day",))


@query("j06_reference_network", _NET.sql(NET, "SELECT src, dst, n_refs, n_refs_per_day FROM net"))
def reference_network(spark, sf):
    return _NET.of(tb.network(spark, sf))


@query(
    "a06_network_of_located_events",
    _NET.sql(
        tb.EV.replace("ON c.c_custkey = e.user_id)", "ON c.c_custkey = e.user_id WHERE e.ts >= TIMESTAMP '2024-01-05' AND e.ts <= TIMESTAMP '2024-01-20')") + tb.NW,
        "SELECT src, dst, n_refs, n_refs_per_day FROM net",
    ),
)
def network_of_located_events(spark, sf):
    """The same from events that already carry a region, between two closed time bounds."""
    return _NET.of(nw.reference_network(tb.located_events(spark, sf), "2024-01-05", "2024-01-20"))


# ---- edge lists ----

_EDGE = Out(longs=("src", "dst"), doubles=("weight",))

DIST = """
dist AS (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst, abs(c_nationkey - s_nationkey) * 25.0 AS distance
         FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
         WHERE c_nationkey <> s_nationkey),
geo0 AS (SELECT src, dst, 1 / CAST(distance AS DOUBLE) AS weight FROM dist WHERE distance < 200 AND src IN (SELECT region FROM rg) AND dst IN (SELECT region FROM rg)),
geo AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS weight FROM geo0),
"""


def distances(spark, sf):
    """Distances between customer and supplier regions that trade with each other."""
    pairs = tb.trade(spark, sf).select("src", "dst")
    return pairs.where("src <> dst").withColumn("distance", F.abs(F.col("src") - F.col("dst")) * 25.0)


@query("p17_distance_edges", _EDGE.sql(tb.RG + DIST, "SELECT * FROM geo"))
def distance_edges(spark, sf):
    return _EDGE.of(nw.distance_edges(distances(spark, sf), tb.regions(spark, sf)))


@query("p18_interaction_edges", _EDGE.sql(NET, "SELECT * FROM edg"))
def interaction_edges(spark, sf):
    return _EDGE.of(nw.interaction_edges(tb.network(spark, sf), tb.users(spark, sf)))


PW = """
pw0 AS (SELECT g.src, g.dst, g.weight * b.population / a.population AS weight FROM geo0 g JOIN rg a ON a.region = g.src JOIN rg b ON b.region = g.dst),
pw AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS weight FROM pw0),
"""


@query("p19_population_weighted", _EDGE.sql(tb.RG + DIST + PW, "SELECT * FROM pw"))
def population_weighted(spark, sf):
    r = tb.regions(spark, sf)
    return _EDGE.of(nw.population_weighted(nw.distance_edges(distances(spark, sf), r, normalize=False), r))


# ---- neighbour means and exposure ----

_MEAN = Out(longs=("region",), strings=("date",), doubles=("V_near", "C_near"))
_MEAN_SQL = """
ed AS MATERIALIZED (SELECT src, dst, weight FROM {0}), hs AS MATERIALIZED (SELECT DISTINCT src FROM ed),
nm AS MATERIALIZED (SELECT e.src AS region, p.date, sum(e.weight * p.V) AS v, sum(e.weight * p.C) AS c FROM ed e JOIN op p ON p.region = e.dst GROUP BY 1, 2),
"""
_MEAN_SELECT = (
    "SELECT op.region, strftime(op.date, '%Y-%m-%d') AS date, CASE WHEN hs.src IS NOT NULL THEN coalesce(nm.v, 0) END AS V_near, "
    "CASE WHEN hs.src IS NOT NULL THEN coalesce(nm.c, 0) END AS C_near FROM op LEFT JOIN hs ON hs.src = op.region LEFT JOIN nm ON nm.region = op.region AND nm.date = op.date"
)


@query("p20_neighbour_mean", _MEAN.sql(tb.OP + tb.EV + tb.NW + _MEAN_SQL.format("edg"), _MEAN_SELECT))
def neighbour_mean(spark, sf):
    edges = nw.interaction_edges(tb.stored_network(spark, sf), tb.users(spark, sf))
    return _MEAN.of(dated(nw.neighbour_mean(tb.order_panel(spark, sf), ["V", "C"], edges, "_near")))


@query("p20_neighbour_mean_by_distance", _MEAN.sql(tb.OP + DIST + PW + _MEAN_SQL.format("pw"), _MEAN_SELECT))
def neighbour_mean_by_distance(spark, sf):
    """Edges by distance, weighted by population."""
    p = tb.order_panel(spark, sf)
    r = tb.regions(spark, sf)
    edges = cut_lineage(nw.population_weighted(nw.distance_edges(distances(spark, sf), r, normalize=False), r))
    return _MEAN.of(dated(nw.neighbour_mean(p, ["V", "C"], edges, "_near")))


@query("p20_neighbour_mean_in_blocks", _MEAN.sql(tb.OP + tb.EV + tb.NW + _MEAN_SQL.format("edg"), _MEAN_SELECT))
def neighbour_mean_in_blocks(spark, sf):
    """The plan for edge lists beyond any broadcast: source blocks x target blocks, partial sums per block."""
    edges = nw.interaction_edges(tb.stored_network(spark, sf), tb.users(spark, sf))
    return _MEAN.of(dated(nw.neighbour_mean(tb.order_panel(spark, sf), ["V", "C"], edges, "_near", blocks=(16, 16))))


_EXPO = Out(longs=("region",), strings=("date",), doubles={"rate_exposure": 9})


@query(
    "p21_exposure",
    _EXPO.sql(
        tb.AP + tb.NW + "x AS (SELECT e.src AS region, p.date, sum(e.n_refs_per_day * (p.cumulative_flagged / p.population) * p.population) AS s FROM net e JOIN ap p ON p.region = e.dst GROUP BY 1, 2)",
        "SELECT ap.region, strftime(ap.date, '%Y-%m-%d') AS date, CASE WHEN ap.region IN (SELECT src FROM net) THEN coalesce(s, 0) END / population AS rate_exposure "
        "FROM ap LEFT JOIN x ON x.region = ap.region AND x.date = ap.date",
    ),
)
def exposure(spark, sf):
    """Neighbours' flagged events per head, over edges that are not normalised."""
    p = tb.activity_panel(spark, sf).select("region", "date", "population", (F.col("cumulative_flagged") / F.col("population")).alias("rate"))
    edges = nw.interaction_edges(tb.stored_network(spark, sf), tb.users(spark, sf), normalize=False)
    return _EXPO.of(dated(nw.exposure(p, ["rate"], edges)))


# ---- whole-network questions ----

_ENDS = Out(longs=("src", "dst", "n_refs"), doubles={"src_balance": 6, "dst_balance": 6, "src_population": 0, "dst_population": 0})


@query(
    "j10_both_ends",
    _ENDS.sql(NET + tb.RG, "SELECT src, dst, n_refs, a.balance AS src_balance, b.balance AS dst_balance, a.population AS src_population, b.population AS dst_population FROM net JOIN rg a ON a.region = src JOIN rg b ON b.region = dst"),
)
def both_ends(spark, sf):
    return _ENDS.of(nw.attach_both_ends(tb.network(spark, sf), tb.regions(spark, sf), ["balance", "population"]))


@query(
    "j10_both_ends_of_hubs",
    _ENDS.sql(NET + tb.RG, "SELECT src, dst, n_refs, a.balance AS src_balance, b.balance AS dst_balance, a.population AS src_population, b.population AS dst_population FROM net JOIN rg a ON a.region = src JOIN rg b ON b.region = dst"),
)
def both_ends_of_hubs(spark, sf):
    """The same with the edges of much-connected regions spread."""
    return _ENDS.of(nw.attach_both_ends(tb.network(spark, sf), tb.regions(spark, sf), ["balance", "population"], hubs=True))


DENSE = """
dense AS (SELECT a.src, b.dst, coalesce(net.n_refs, 0) AS n_refs FROM (SELECT DISTINCT src FROM net) a CROSS JOIN (SELECT DISTINCT dst FROM net) b
          LEFT JOIN net ON net.src = a.src AND net.dst = b.dst),
"""
_DSUM = Out(longs=("n_src", "n_dst", "n_pairs", "n_edges", "n_padded"), doubles=("mean_weight", "std_weight"))


@query(
    "j08_dense_network_summary",
    _DSUM.sql(
        NET + DENSE,
        "SELECT count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst, count(*) AS n_pairs, count(*) FILTER (n_refs > 0) AS n_edges, count(*) FILTER (n_refs = 0) AS n_padded, "
        "avg(n_refs) AS mean_weight, stddev_pop(n_refs) AS std_weight FROM dense",
    ),
)
def dense_network_summary(spark, sf):
    """The zero-padded network's size and weights, computed from its edges alone."""
    return _DSUM.of(nw.dense_summary(tb.network(spark, sf)))


_HOM = Out(longs=("n_pairs",), strings=("attribute",), doubles={"mean_dist": 6, "corr": 6})
_HOM_SQL = "SELECT '{0}' AS attribute, count(*) AS n_pairs, avg(abs(a.{0} - b.{0})) AS mean_dist, corr(n_refs, abs(a.{0} - b.{0})) AS corr FROM dense JOIN rg a ON a.region = src JOIN rg b ON b.region = dst"


@query("e06_dense_homophily", _HOM.sql(NET + DENSE + tb.RG, _HOM_SQL.format("balance") + " UNION ALL " + _HOM_SQL.format("population")))
def dense_homophily(spark, sf):
    """Do regions that refer to each other resemble each other? Over all pairs, those without references included."""
    net, r = tb.stored_network(spark, sf), tb.regions(spark, sf)
    return _HOM.of(nw.dense_homophily(net, r, "balance").unionByName(nw.dense_homophily(net, r, "population")))


_SPH = Out(strings=("attribute",), doubles=("corr_log",))


@query(
    "e06_sparse_homophily",
    _SPH.sql(
        NET + tb.RG + "x AS (SELECT ln(n_refs) AS w, abs(a.balance - b.balance) AS d1, abs(a.population - b.population) AS d2 FROM net JOIN rg a ON a.region = src JOIN rg b ON b.region = dst)",
        "SELECT 'balance' AS attribute, corr(w, d1) AS corr_log FROM x UNION ALL SELECT 'population', corr(w, d2) FROM x",
    ),
)
def sparse_homophily(spark, sf):
    return _SPH.of(nw.sparse_homophily(tb.network(spark, sf), tb.regions(spark, sf), ["balance", "population"]))


_SCI = Out(longs=("n_pairs",), doubles=("corr",))


@query(
    "e09_index_correlation",
    _SCI.sql(
        NET
        + """idx AS (SELECT c_nationkey AS src, s_nationkey AS dst, CAST(count(*) AS DOUBLE) AS idx
             FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)""",
        "SELECT count(*) AS n_pairs, corr(idx, coalesce(n_refs, 0)) AS corr FROM idx LEFT JOIN net ON net.src = idx.src AND net.dst = idx.dst",
    ),
)
def index_correlation(spark, sf):
    """Trade between customer and supplier regions beside the reference network."""
    idx = tb.trade(spark, sf).withColumn("n", F.col("n").cast("double"))
    return _SCI.of(nw.index_correlation(idx, tb.network(spark, sf), "n"))


_CMP = Out(longs=("n_pairs",), doubles=("corr",))
_HALF = """
{0} AS (SELECT e.region AS src, o.region AS dst, count(*) / (SELECT CAST((epoch_us(max(event_time)) - epoch_us(min(event_time))) // 86400000000 AS DOUBLE) FROM ev WHERE {1}) AS r
  FROM ev e JOIN (SELECT DISTINCT event_id, region FROM ev WHERE {1}) o ON o.event_id = e.ref_id WHERE e.ref_id <> -1 AND e.{1} GROUP BY 1, 2),
"""


@query(
    "e10_early_late_network",
    _CMP.sql(
        tb.EV + _HALF.format("early", "event_time <= TIMESTAMP '2024-01-15 12:00:00'") + _HALF.format("late", "event_time >= TIMESTAMP '2024-01-15 12:00:00'"),
        "SELECT count(*) AS n_pairs, corr(coalesce(a.r, 0), coalesce(b.r, 0)) AS corr FROM early a FULL JOIN late b ON b.src = a.src AND b.dst = a.dst",
    ),
)
def early_late_network(spark, sf):
    cut = "2024-01-15 12:00:00"
    return _CMP.of(nw.network_comparison(tb.network(spark, sf, last=cut), tb.network(spark, sf, first=cut)))


_MAP = Out(strings=("code",), doubles={"rate": 9, "rate_log": 6})


@query(
    "e11_rate_map",
    _MAP.sql(
        tb.AP + "x AS (SELECT region, population, max(cumulative_flagged) AS m FROM ap GROUP BY 1, 2), y AS (SELECT region, m / (population * (SELECT count(DISTINCT date) FROM ap)) AS rate FROM x)",
        "SELECT lpad(CAST(region AS VARCHAR), 5, '0') AS code, rate, log10(nullif(rate, 0)) AS rate_log FROM y",
    ),
)
def rate_map(spark, sf):
    return _MAP.of(rg.rate_map(tb.activity_panel(spark, sf), "cumulative_flagged"))


@query(
    "e11_rate_map_last_rows",
    _MAP.sql(
        tb.SO + tb.RG + "x AS (SELECT region, max(date) AS d, arg_max(n, date) AS m FROM so GROUP BY 1), y AS (SELECT x.region, m / (population * (SELECT count(DISTINCT d) FROM x)) AS rate FROM x JOIN rg USING (region))",
        "SELECT lpad(CAST(region AS VARCHAR), 5, '0') AS code, rate, log10(nullif(rate, 0)) AS rate_log FROM y",
    ),
)
def rate_map_last_rows(spark, sf):
    """Days counted over the regions' last rows only."""
    s = tb.sparse_orders(spark, sf).join(tb.regions(spark, sf).select("region", "population"), "region")
    return _MAP.of(rg.rate_map(s, "n", per_last_row=True))
