"""Region-to-region networks and what flows over them.

An edge list is a table (src, dst, weight), unique on (src, dst).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.nulls import ratio
from panelspark.operators.skew import prefix_sums, salted_join


def reference_network(
    events: DataFrame,
    first: str | None = None,
    last: str | None = None,
    time: str = "event_time",
    users: DataFrame | None = None,
) -> DataFrame:
    """References counted per (src region, dst region), with the rate per day; both time bounds are closed.

    References are counted per (region, referenced event) before the join, so
    an event that everyone refers to adds at most one row per region to it.
    With ``users`` the events carry no region: it is joined to counts per user,
    on the referring side before that join, on the other side after it.
    """
    if first is not None:
        events = events.where(F.col(time) >= F.lit(first).cast("timestamp_ntz"))
    if last is not None:
        events = events.where(F.col(time) <= F.lit(last).cast("timestamp_ntz"))
    refs = events.where(F.col("ref_id") != -1)
    if users is None:
        owners = events.select(F.col("event_id").alias("ref_id"), F.col("region").alias("dst")).distinct()
        counts = refs.groupBy(F.col("region").alias("src"), "ref_id").agg(F.count("event_id").alias("_n"))
        pairs = counts.join(owners, "ref_id").groupBy("src", "dst").agg(F.sum("_n").alias("n_refs"))
        spans = events.agg(F.min(time).alias("a"), F.max(time).alias("b"))
    else:
        known = users.select("user_id", "region")
        per_user = refs.groupBy("user_id", "ref_id").agg(F.count("event_id").alias("_n"))
        placed = salted_join(per_user, known, ["user_id"], spread=["ref_id"])
        counts = placed.groupBy(F.col("region").alias("src"), "ref_id").agg(F.sum("_n").alias("_n"))
        owners = events.select(F.col("event_id").alias("ref_id"), "user_id").distinct()
        to_user = counts.join(owners, "ref_id").groupBy("src", "user_id").agg(F.sum("_n").alias("_n"))
        pairs = to_user.join(known, "user_id").groupBy("src", F.col("region").alias("dst")).agg(F.sum("_n").alias("n_refs"))
        per_user_span = events.groupBy("user_id").agg(F.min(time).alias("a"), F.max(time).alias("b"))
        spans = per_user_span.join(known.select("user_id"), "user_id", "left_semi").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    edges = pairs.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    micros = F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))
    days = spans.select(F.floor(micros / 86_400_000_000)).scalar()
    return edges.withColumn("n_refs_per_day", ratio(F.col("n_refs").cast("double"), days))


def normalised(edges: DataFrame) -> DataFrame:
    """Weights of each source divided by their sum.

    Sums are taken per source and joined back, which unlike a window does not
    gather a well-connected source's edges in one task.
    """
    norm = edges.groupBy("src").agg(F.sum("weight").alias("_norm"))
    return edges.join(norm, "src").select("src", "dst", ratio(F.col("weight"), F.col("_norm")).alias("weight"))


def within(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """Edges with both ends among the regions."""
    known = regions.select("region").distinct()
    kept = edges.join(known.withColumnRenamed("region", "src"), "src", "left_semi")
    return kept.join(known.withColumnRenamed("region", "dst"), "dst", "left_semi")


def distance_edges(distances: DataFrame, regions: DataFrame, power: float = -1.0, max_distance: float = 200.0, normalize: bool = True) -> DataFrame:
    """Edges between regions closer than ``max_distance``, weighted by distance ** power.

    ``distances`` holds (src, dst, distance).
    """
    near = within(distances.where(F.col("distance") < max_distance), regions)
    edges = near.select("src", "dst", F.pow("distance", F.lit(power)).alias("weight"))
    return normalised(edges) if normalize else edges


def interaction_edges(network: DataFrame, regions: DataFrame, normalize: bool = True) -> DataFrame:
    """Edges weighted by references per day."""
    edges = within(network, regions).select("src", "dst", F.col("n_refs_per_day").alias("weight"))
    return normalised(edges) if normalize else edges


def population_weighted(edges: DataFrame, populations: DataFrame) -> DataFrame:
    """Weights times the population ratio dst / src, normalised again. ``populations`` holds (region, population)."""
    pops = populations.select("region", "population").distinct()
    both = attach_both_ends(edges, pops, ["population"])
    w = F.col("weight") * ratio(F.col("dst_population").cast("double"), F.col("src_population"))
    return normalised(both.select("src", "dst", w.alias("weight")))


def attach_both_ends(edges: DataFrame, attributes: DataFrame, cols: Sequence[str], how: str = "inner", hubs: bool = False) -> DataFrame:
    """Adds every attribute of the source and of the target in two joins, as src_x and dst_x.

    ``hubs`` spreads the edges of a region with a large share of them over
    several tasks; ``attributes`` then has one row per region.
    """
    src = attributes.select(F.col("region").alias("src"), *[F.col(c).alias(f"src_{c}") for c in cols])
    dst = attributes.select(F.col("region").alias("dst"), *[F.col(c).alias(f"dst_{c}") for c in cols])
    if hubs:
        return salted_join(salted_join(edges, src, ["src"], how, spread=["dst"]), dst, ["dst"], how, spread=["src"])
    return edges.join(src, "src", how).join(dst, "dst", how)


def in_blocks(edges: DataFrame, values: DataFrame, blocks: tuple[int, int]) -> DataFrame:
    """Edges beside the values of their targets, with the block of their source and of their target.

    Sources and targets are dealt into ``blocks`` by hash. A target's values go
    to the source blocks that hold an edge to it, never to more of them than it
    has edges, so a hub's edges meet its values in as many tasks as there are
    source blocks.
    """
    dealt = edges.withColumns({"_i": F.pmod(F.xxhash64("src"), F.lit(blocks[0])), "_j": F.pmod(F.xxhash64("dst"), F.lit(blocks[1]))})
    wanted = dealt.select("dst", "_i").distinct()
    return dealt.join(values.join(wanted, "dst"), ["dst", "_i"])


def neighbour_mean(
    df: DataFrame,
    cols: Sequence[str],
    edges: DataFrame,
    suffix: str = "_neighbor_mean",
    region: str = "region",
    date: str = "date",
    blocks: tuple[int, int] | None = None,
) -> DataFrame:
    """Adds, per (region, date), the edge-weighted sum of each column over the region's targets.

    A target without a value adds 0; a region without edges gets NULL. One join
    and one aggregate serve all columns and dates. With ``blocks`` (of sources,
    of targets) the edges are joined block by block and a source's sums are
    first taken per block of targets, so neither a much-referenced target nor a
    source of many edges is one task's work.
    """
    names = [f"{c}{suffix}" for c in cols]
    values = df.select(F.col(region).alias("dst"), date, *cols)
    sums = [F.sum(F.col("weight") * F.col(c)).alias(n) for c, n in zip(cols, names)]
    key = [F.col("src").alias(region), F.col(date)]
    if blocks is None:
        means = edges.join(values, "dst").groupBy(*key).agg(*sums)
    else:
        partial = in_blocks(edges, values, blocks).groupBy(*key, "_j").agg(*sums)
        means = partial.groupBy(region, date).agg(*[F.sum(n).alias(n) for n in names])
    sources = edges.select(F.col("src").alias(region)).distinct().withColumn("_has_edges", F.lit(True))
    joined = df.join(means, [region, date], "left").join(sources, region, "left")
    out: list[Column] = [F.when(F.col("_has_edges"), F.coalesce(F.col(n), F.lit(0.0))).alias(n) for n in names]
    return joined.select(*df.columns, *out)


def exposure(
    df: DataFrame,
    cols: Sequence[str],
    edges: DataFrame,
    population: str = "population",
    region: str = "region",
    date: str = "date",
    blocks: tuple[int, int] | None = None,
) -> DataFrame:
    """Adds ``x_exposure``: neighbours' x times their population, per head of the region's own population."""
    products = [f"{c}_xpop" for c in cols]
    scaled = df.withColumns({p: F.col(c) * F.col(population) for c, p in zip(cols, products)})
    means = neighbour_mean(scaled, products, edges, "_mean", region, date, blocks)
    return means.select(*df.columns, *[ratio(F.col(f"{p}_mean"), F.col(population)).alias(f"{c}_exposure") for c, p in zip(cols, products)])


def network_comparison(early: DataFrame, late: DataFrame) -> DataFrame:
    """Correlation of two networks' rates over the pairs present in either, 0 where absent."""
    a = early.select("src", "dst", F.col("n_refs_per_day").alias("early"))
    b = late.select("src", "dst", F.col("n_refs_per_day").alias("late"))
    both = a.join(b, ["src", "dst"], "full").fillna(0.0, subset=["early", "late"])
    return both.agg(F.count(F.lit(1)).alias("n_pairs"), F.corr("early", "late").alias("corr"))


def index_correlation(index: DataFrame, network: DataFrame, index_col: str, network_col: str = "n_refs") -> DataFrame:
    """Correlation of an outside (src, dst, index) table with the network, 0 where the network has no edge."""
    joined = index.join(network.select("src", "dst", network_col), ["src", "dst"], "left").fillna(0, subset=[network_col])
    return joined.agg(F.count(F.lit(1)).alias("n_pairs"), F.corr(index_col, network_col).alias("corr"))


def sparse_homophily(edges: DataFrame, attributes: DataFrame, cols: Sequence[str], weight: str = "n_refs") -> DataFrame:
    """(attribute, corr_log): correlation of |src - dst| with the log weight over existing edges.

    A pair without an edge has no logarithm, so the padded network adds nothing here.
    """
    both = attach_both_ends(edges.where(F.col(weight) > 0), attributes, cols)
    dists = {c: F.abs(F.col(f"src_{c}") - F.col(f"dst_{c}")) for c in cols}
    row = both.agg(*[F.corr(d, F.ln(weight)).alias(c) for c, d in dists.items()])
    return row.unpivot([], list(cols), "attribute", "corr_log")


def dense_homophily(edges: DataFrame, attributes: DataFrame, col: str, weight: str = "n_refs") -> DataFrame:
    """Correlation of |src - dst| with the weight over all sources x all targets, absent pairs weighing 0.

    The padded network is never built. Over all pairs, the squared distances
    follow from sums and sums of squares per side, and the distances from one
    sorted pass: a value y adds y * (sources below) - (sum of sources below)
    and the mirror image above. Only edges touch the weight sums.
    """
    known = attributes.where(F.col(col).isNotNull()).select("region", F.col(col).cast("double").alias("x"))
    srcs = edges.select(F.col("src").alias("region")).distinct().join(known, "region").select("x", F.lit(1).alias("s"), F.lit(0).alias("d"))
    dsts = edges.select(F.col("dst").alias("region")).distinct().join(known, "region").select("x", F.lit(0).alias("s"), F.lit(1).alias("d"))
    values = srcs.unionByName(dsts).groupBy("x").agg(F.sum("s").alias("s"), F.sum("d").alias("d"))
    values = values.withColumns({"sx": F.col("s") * F.col("x"), "dx": F.col("d") * F.col("x")})
    ordered = prefix_sums(values, "x", ["s", "sx", "d", "dx"])
    # each unordered (below, above) pair is met once from its upper value
    dist = F.col("d") * (F.col("x") * F.col("s_below") - F.col("sx_below")) + F.col("s") * (F.col("x") * F.col("d_below") - F.col("dx_below"))
    x2 = F.col("x") * F.col("x")
    pairs = ordered.agg(
        F.sum("s").alias("ns"),
        F.sum("d").alias("nd"),
        F.sum(dist).alias("sum_dist"),
        F.sum("sx").alias("s1"),
        F.sum("dx").alias("d1"),
        F.sum(F.col("s") * x2).alias("s2"),
        F.sum(F.col("d") * x2).alias("d2"),
    ).withColumn("_k", F.lit(0))
    both = attach_both_ends(edges, known, ["x"])
    w = F.col(weight).cast("double")
    near = both.agg(
        F.coalesce(F.sum(w), F.lit(0.0)).alias("w1"),
        F.coalesce(F.sum(w * w), F.lit(0.0)).alias("w2"),
        F.coalesce(F.sum(w * F.abs(F.col("src_x") - F.col("dst_x"))), F.lit(0.0)).alias("wd"),
    ).withColumn("_k", F.lit(0))
    n = (F.col("ns") * F.col("nd")).cast("double")
    sum_sq = F.col("nd") * F.col("s2") + F.col("ns") * F.col("d2") - 2 * F.col("s1") * F.col("d1")
    cov = F.col("wd") - F.col("w1") * F.col("sum_dist") / n
    var_w = F.col("w2") - F.col("w1") * F.col("w1") / n
    var_d = sum_sq - F.col("sum_dist") * F.col("sum_dist") / n
    corr = F.when((var_w > 0) & (var_d > 0), cov / F.sqrt(var_w * var_d))
    return pairs.join(near, "_k").select(
        F.lit(col).alias("attribute"), n.cast("bigint").alias("n_pairs"), (F.col("sum_dist") / n).alias("mean_dist"), corr.alias("corr")
    )


def dense_summary(edges: DataFrame, weight: str = "n_refs") -> DataFrame:
    """Size, filled pairs, mean and spread of the weight over all sources x all targets, absent pairs weighing 0."""
    w = F.col(weight).cast("double")
    row = edges.agg(
        F.count_distinct("src").alias("n_src"), F.count_distinct("dst").alias("n_dst"),
        F.count(F.lit(1)).alias("n_edges"), F.sum(w).alias("w1"), F.sum(w * w).alias("w2"),
    )
    n = F.col("n_src") * F.col("n_dst")
    mean = F.col("w1") / n
    return row.select("n_src", "n_dst", n.alias("n_pairs"), "n_edges", (n - F.col("n_edges")).alias("n_padded"),
                      mean.alias("mean_weight"), F.sqrt(F.col("w2") / n - mean * mean).alias("std_weight"))
