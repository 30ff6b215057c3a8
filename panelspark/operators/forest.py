"""Random forests of many bootstrap replicates at once, grown level by level from histograms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce
from math import ceil, exp, prod
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.hashing import HASH_SPAN, h32_of_pairs
from panelspark.operators.resampling import resampled
from panelspark.operators.skew import beside
from panelspark.operators.stats import quantiles
from panelspark.session import cut_lineage

BINS = 32


# Cells of the sums that a task holds, and drawn rows that it takes at a time.
HELD = 4_000_000
ROWS = 65_536


@lru_cache(maxsize=64)
def poisson_table(rate: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(limits, weights, open) for Poisson weights of an integer rate from 32-bit hashes.

    A weight is the number of ``limits``, the distribution function at 0, 1, 2..
    in units of the hash, that the hash reaches. ``weights`` holds it by the
    hash's upper 16 bits, save where these leave it ``open``.
    """
    term, total, steps = exp(-rate), 0.0, []
    for k in range(rate * 3 + 13):
        total += term
        steps.append(ceil(total * HASH_SPAN))
        term = term * rate / (k + 1)
    limits = np.array(steps, np.int64)
    low = np.arange(1 << 16, dtype=np.int64) << 16
    weights = np.searchsorted(limits, low, side="right")
    return limits, weights, weights != np.searchsorted(limits, low | 0xFFFF, side="right")


def poisson(rate: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Poisson weights of each row's rate, one per column of its hashes."""
    out = np.empty(hashes.shape, np.int64)
    for r in np.unique(rate).tolist():
        limits, weights, unsure = poisson_table(r)
        own = hashes[rate == r]
        lead = own >> 16
        drawn, rest = weights[lead], unsure[lead]
        drawn[rest] = np.searchsorted(limits, own[rest], side="right")
        out[rate == r] = drawn
    return out


def binned(df: DataFrame, key: str, y: str, xs: Sequence[str], bins: int = BINS) -> DataFrame:
    """(key, y, b): y about its mean, and the number of each x's bin between its quantiles."""
    rows = df.select(key, F.col(y).cast("double").alias("y"), *[F.col(x).cast("double").alias(x) for x in xs])
    long = rows.unpivot([], list(xs), "x", "value")
    edges: dict[str, list[float]] = {x: [] for x in xs}
    for x, value in quantiles(long, "value", [i / bins for i in range(1, bins)], ["x"]).select("x", "value").collect():
        edges[x].append(value)
    mean = rows.agg(F.avg("y")).scalar()
    places = [reduce(add, [(F.col(x) > e).cast("int") for e in sorted(set(edges[x]))], F.lit(0)) for x in xs]
    return rows.select(key, (F.col("y") - mean).alias("y"), F.array(*places).alias("b"))


class Splits:
    """The splits of all trees found so far by replicate, tree and node; there are at most 2^depth per tree."""

    def __init__(self, reps: int, trees: int, levels: int, found: DataFrame | None) -> None:
        self.levels = levels
        self.feature = np.full((reps, trees, 1 << levels), -1, np.int32)
        self.cut = self.feature.copy()
        if found is not None:
            rep, tree, node, feature, cut = (c.to_numpy() for c in found.select("rep", "tree", "node", "feature", F.coalesce("cut", F.lit(-1))).toArrow().columns)
            self.feature[rep, tree, node], self.cut[rep, tree, node] = feature, cut

    def node(self, rep: int, tree: np.ndarray, row: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """The node of the last level that a row of bins reaches in a tree, 0 for none; the children of k are 2k and 2k + 1."""
        node = np.ones(len(row), np.int32)
        for _ in range(self.levels):
            feature, cut = self.feature[rep, tree, node], self.cut[rep, tree, node]
            value = bins[row, feature]
            # what is missing is on neither side of a cut
            node = np.where((feature >= 0) & (cut >= 0) & (value >= 0), 2 * node + (value > cut), 0)
        return node


def level_sums(drawn: DataFrame, key: str, features: int, trees: int, seed: int | str, splits: Splits, bins: int) -> DataFrame:
    """(rep, tree, node, feature, bin, w, s, q): sums of weights, of y and of its square at the nodes of a level.

    Each task adds up its own rows, the parts of all tasks meet in one aggregate.
    """
    low, slots = 1 << splits.levels, bins + 1  # slot 0: the bin is missing
    shape = (trees, low, features, slots)
    schema = T.StructType(
        [T.StructField("rep", T.LongType()), *[T.StructField(c, T.IntegerType()) for c in ("tree", "node", "feature", "bin")], *[T.StructField(c, T.DoubleType()) for c in ("w", "s", "q")]]
    )

    def told(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for rep, total in sums.items():
            at = np.flatnonzero(total[0])
            tree, node, feature, slot = np.unravel_index(at, shape)
            columns = [np.full(len(at), rep), *[c.astype(np.int32) for c in (tree, node + low, feature, slot - 1)], *total[:, at]]
            arrays = [pa.array(c, mask=c < 0) if i == 4 else pa.array(c) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for rows in _gathered(batches, ROWS):
            names = np.array(["" if k is None else f"|{k}" for k in rows.column("_key").to_pylist()], object)
            weight, places = rows.column("weight").to_numpy(), rows.column("b").combine_chunks()
            b = places.flatten().fill_null(-1).to_numpy(zero_copy_only=False).reshape(-1, features)
            missing, y = rows.column("y").is_null().to_numpy(), rows.column("y").fill_null(0.0).to_numpy()
            reps = rows.column("rep").to_numpy()
            order = np.argsort(reps, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(reps[order])) + 1):
                rep = int(reps[own[0]])
                if rep not in sums and (len(sums) + 1) * 3 * prod(shape) > HELD and sums:
                    yield from told(sums)
                    sums = {}
                hashes = h32_of_pairs([f"{seed}-tree|{rep}|{t}" for t in range(trees)], names[own].tolist())
                w = poisson(weight[own], hashes)
                row, tree = np.nonzero(w)
                w = w[row, tree].astype(float)
                node = splits.node(rep, tree, row, b[own])
                here = node >= low
                if not here.all():
                    row, tree, w, node = row[here], tree[here], w[here], node[here]
                value = y[own][row]
                cell = ((tree * low + (node - low)) * features) * slots + 1
                wy = w * value
                total = sums.setdefault(rep, np.zeros((3, prod(shape))))
                for f in range(features):
                    at = cell + f * slots + b[own, f][row]
                    for part, add in zip(total, (w, wy, wy * value)):
                        part += np.bincount(at, add, len(part))
        yield from told(sums)

    parts = drawn.select("rep", F.col(key).cast("string").alias("_key"), "weight", "y", "b").mapInArrow(add_up, schema)
    return parts.groupBy("rep", "tree", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("w", "s", "q")])


def _gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Rows in tables of at least so many, but for the last."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        kept += [batch] if batch.num_rows else []
        if sum(b.num_rows for b in kept) >= least:
            yield pa.Table.from_batches(kept)
            kept = []
    if kept:
        yield pa.Table.from_batches(kept)


def grow(drawn: DataFrame, key: str, features: int, reps: int, trees: int, seed: int | str, depth: int, bins: int = BINS) -> DataFrame:
    """(rep, tree, node, feature, cut, gain, left, right): the splits of all trees, with the means on either side.

    ``drawn`` holds (rep, key, weight, y, b). A tree draws again from its
    replicate: a row that stands there w times gets a Poisson(w) weight from a
    hash. One aggregate per level sums up (replicate, tree, node, feature, bin);
    no row leaves its task.
    """
    found = None
    for level in range(depth):
        sums = level_sums(drawn, key, features, trees, seed, Splits(reps, trees, level, found), bins)
        own = W.partitionBy("rep", "tree", "node", "feature")
        upto = own.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
        cut = sums.select(
            "rep", "tree", "node", "feature", F.col("bin").alias("cut"), F.sum("w").over(upto).alias("wl"), F.sum("s").over(upto).alias("sl"),
            F.sum("w").over(own).alias("w"), F.sum("s").over(own).alias("s"), F.sum("q").over(own).alias("q"),
        ).where("wl < w")
        right, rest = F.col("w") - F.col("wl"), F.col("s") - F.col("sl")
        gain = F.col("sl") ** 2 / F.col("wl") + rest**2 / right - F.col("s") ** 2 / F.col("w")
        spread = F.col("q") - F.col("s") ** 2 / F.col("w")
        # equal parts by another feature differ in rounding only
        share = F.round(gain / spread, 9)
        cut = cut.where(spread > 0).withColumns({"gain": gain, "share": share, "left": F.col("sl") / F.col("wl"), "right": rest / right})
        row = F.struct(*[c for c in ("feature", "cut", "gain", "left", "right")])
        best = cut.where("share > 0").groupBy("rep", "tree", "node").agg(F.min_by(row, F.struct(-F.col("share"), "feature", "cut")).alias("x")).select("rep", "tree", "node", "x.*")
        best = cut_lineage(best)
        found = best if found is None else found.unionByName(best)
    return found


def forests(every: DataFrame, splits: DataFrame | None) -> DataFrame:
    """(rep, tree, splits): each tree's splits by node."""
    kind = "map<int, struct<feature:int,cut:int,left:double,right:double>>"
    if splits is None:
        return every.withColumn("splits", F.create_map().cast(kind))
    entry = F.struct("node", F.struct("feature", "cut", "left", "right"))
    own = splits.groupBy("rep", "tree").agg(F.map_from_entries(F.collect_list(entry)).alias("splits"))
    return every.join(own, ["rep", "tree"], "left").withColumn("splits", F.coalesce(F.col("splits").cast(kind), F.create_map().cast(kind)))


def forest_importances(df: DataFrame, key: str, y: str, xs: Sequence[str], reps: int, seed: int | str, depth: int = 2, trees: int = 100, bins: int = BINS) -> DataFrame:
    """(rep, feature, importance, explained_variance) of a random forest per bootstrap replicate.

    A split's worth is the squared error it removes; worths are scaled to one
    per tree and averaged over the trees that split. The prediction for a row is
    the mean over the trees of the mean of its leaf; the variance it explains is
    taken over the replicate's own rows.
    """
    rows = binned(df, key, y, xs, bins)
    drawn = cut_lineage(resampled(rows, [key], reps, seed))
    splits = grow(drawn, key, len(xs), reps, trees, seed, depth, bins)
    share = F.sum("gain") / F.sum(F.sum("gain")).over(W.partitionBy("rep", "tree"))
    per_tree = splits.groupBy("rep", "tree", "feature").agg(share.alias("part"))
    split_trees = per_tree.groupBy("rep").agg(F.count_distinct("tree").alias("n"))
    total = per_tree.groupBy("rep", "feature").agg(F.sum("part").alias("part"))
    names = F.array(*[F.lit(x) for x in xs])
    every = split_trees.select("rep", "n", F.posexplode(names).alias("at", "feature"))
    parts = every.join(total.withColumnRenamed("feature", "at"), ["rep", "at"], "left").select("rep", "feature", (F.coalesce("part", F.lit(0.0)) / F.col("n")).alias("importance"))

    model = forests(splits.select("rep", "tree").distinct(), splits).groupBy("rep").agg(F.collect_list("splits").alias("forest"))
    # a forest tells rows of the same bins the same
    known = F.when(F.col("y").isNotNull(), F.col("weight"))
    cells = drawn.groupBy("rep", "b").agg(F.sum("weight").alias("all"), F.sum(known).alias("w"), F.sum(known * F.col("y")).alias("s"), F.sum(known * F.col("y") * F.col("y")).alias("q"))
    guess = F.aggregate(F.transform("forest", lambda t: _leaf(t, depth)), F.lit(0.0), lambda a, v: a + v) / F.size("forest")
    told = beside(cut_lineage(cells), model, ["rep"], spread=["b"]).select("rep", "all", "w", "s", "q", guess.alias("g"))
    w, s, q, g = (F.col(c) for c in "wsqg")

    def variance(first: Column, second: Column) -> Column:
        return F.sum(second) / F.sum("all") - F.pow(F.sum(first) / F.sum("all"), 2)

    left = variance(s - w * g, q - 2 * g * s + w * g * g)
    explained = told.groupBy("rep").agg((1 - left / F.nullif(variance(s, q), F.lit(0.0))).alias("explained_variance"))
    return parts.join(explained, "rep")


def _leaf(splits: Column, depth: int) -> Column:
    """The mean of the leaf that a row's bins lead to."""
    node, value = F.lit(1), F.lit(None).cast("double")
    for _ in range(depth):
        split = F.element_at(splits, node)
        goes_right = F.get("b", split["feature"]) > split["cut"]
        value = F.when(split.isNull(), value).otherwise(F.when(goes_right, split["right"]).otherwise(split["left"]))
        node = F.when(split.isNull(), node).otherwise(node * 2 + goes_right.cast("int"))
    return value
