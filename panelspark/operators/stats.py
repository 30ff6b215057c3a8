"""Summary statistics.

Exact order statistics over unbounded columns come from mergeable sketches,
which bracket the wanted ranks, and one scan that counts what lies outside the
brackets; only values inside them are moved.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations
from math import pi
from operator import or_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.functions.nulls import ratio, weighted_mean
from panelspark.operators.skew import beside, positions, salted_join, small_rows
from panelspark.session import cut_lineage


# A sketch's ranks are within n / ACCURACY; brackets are read from it at GRID even steps.
ACCURACY, GRID = 10_000, 1000

# Distinct values inside one group's brackets that one task sorts; more are narrowed by another sketch.
SORTED = 1_000_000


def _bracket(grid: Column, rank: Column, n: Column) -> tuple[Column, Column]:
    """Values of a sketch's grid on either side of a zero-based rank among ``n``, an infinity beyond its ends."""
    lo, hi = F.floor(rank * GRID / n).cast("int") - 1, F.ceil((rank + 1) * GRID / n).cast("int") + 1
    ends = F.when(lo < 0, float("-inf")).otherwise(F.get(grid, lo)), F.when(hi > GRID, float("inf")).otherwise(F.get(grid, hi))
    return tuple(F.coalesce(e, F.lit(x)) for e, x in zip(ends, (float("-inf"), float("inf"))))


def _within(value: Column, lo: Column, hi: Column) -> Column:
    """Inside a bracket; NaN, which sorts last, is inside an open one."""
    return (value >= lo) & ((value <= hi) | (hi == float("inf")))


def _sketch(value: Column) -> Column:
    """GRID + 1 values at even steps of rank, by a summary with a guaranteed error that merges across tasks."""
    return F.percentile_approx(value, [i / GRID for i in range(GRID + 1)], ACCURACY)


def _brackets(rows: DataFrame, group: list[str], probs: Sequence[float]) -> tuple[DataFrame, pa.Table | None]:
    """(group, _n, _at0.., _lo0.., _hi0..): brackets narrow enough that one task can sort a group's values inside them.

    They come with their rows where groups are few, and stored otherwise.
    """

    def held(df: DataFrame, most: str) -> tuple[DataFrame, pa.Table | None, int]:
        known = small_rows(df)
        if known is not None:
            return df, known, pc.max(known.column(most)).as_py() or 0
        df = cut_lineage(df)
        return df, None, df.agg(F.max(most)).first()[0]

    n, which = F.col("_n"), range(len(probs))
    at = {f"_at{i}": (n - 1) * F.lit(float(p)) for i, p in enumerate(probs)}
    first = rows.groupBy(*group).agg(F.count("_v").alias("_n"), _sketch(F.col("_v")).alias("_g")).where("_n > 0").withColumns(at)
    ends = {f"_{e}{i}": c for i in which for e, c in zip(("lo", "hi"), _bracket(F.col("_g"), F.floor(f"_at{i}"), n))}
    found, known, most = held(first.withColumns(ends).drop("_g"), "_n")
    columns = found.columns
    while (most := most * 4 * len(probs) // GRID) > SORTED:
        v, marked = F.col("_v"), _beside_brackets(rows, found, group, known)
        inside = [_within(v, F.col(f"_lo{i}"), F.col(f"_hi{i}")) for i in which]
        again = marked.groupBy(*group).agg(
            *[F.first(c).alias(c) for c in columns if c not in group],
            *[F.count_if(v < F.col(f"_lo{i}")).alias(f"_b{i}") for i in which],
            *[F.count_if(inside[i]).alias(f"_c{i}") for i in which],
            *[_sketch(F.when(inside[i], v)).alias(f"_g{i}") for i in which],
        )
        closer = {f"_{e}{i}": c for i in which for e, c in zip(("lo", "hi"), _bracket(F.col(f"_g{i}"), F.floor(f"_at{i}") - F.col(f"_b{i}"), F.col(f"_c{i}")))}
        tight = {c: (F.greatest if c.startswith("_lo") else F.least)(F.col(c), x) for c, x in closer.items()}
        inner = F.greatest(F.lit(0), *[f"_c{i}" for i in which])
        found, known, most = held(again.withColumns(tight).select(*columns, inner.alias("_most")), "_most")
        found, known = found.drop("_most"), known and known.drop_columns("_most")
    return found, known


def _beside_brackets(rows: DataFrame, brackets: DataFrame, group: list[str], known: pa.Table | None) -> DataFrame:
    if group:
        return beside(rows, brackets, group, spread=["_v"], rows=known)
    one = known.to_pylist()
    return rows.withColumns({f.name: F.lit(one[0][f.name] if one else None).cast(f.dataType) for f in brackets.schema})


def quantiles(df: DataFrame, col: str, probs: Sequence[float], group: Sequence[str] = ()) -> DataFrame:
    """(group, prob, value): exact quantiles with linear interpolation.

    A sketch per group brackets every wanted rank. In a second scan each value
    between brackets only adds to the count, least and greatest of its gap,
    before anything is shuffled; values inside a bracket are counted one by one.
    A rank is then found among these few rows per group, or at the edge of a gap.
    """
    group, p_list = list(group), [float(p) for p in probs]
    rows = df.select(*group, F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    brackets, known = _brackets(rows, group, p_list)
    marked, v = _beside_brackets(rows, brackets, group, known), F.col("_v")
    lo, hi = ([F.col(f"_{e}{i}") for i in range(len(p_list))] for e in ("lo", "hi"))
    inside = reduce(or_, [_within(v, a, b) for a, b in zip(lo, hi)])
    # a gap is named after the bracket end below it
    gap = F.greatest(F.lit(float("-inf")), *[F.when(v > b, b) for b in hi], F.lit(None).cast("double"))
    cells = marked.groupBy(*group, F.when(inside, v).otherwise(gap).alias("_at"), (~inside).alias("_gap"))
    counts = cells.agg(F.count(v).alias("_c"), F.min(v).alias("_min"), F.max(v).alias("_max"), F.first("_n").alias("_n"))
    before = W.partitionBy(*group).orderBy("_at", "_gap").rowsBetween(W.unboundedPreceding, -1)
    placed = counts.withColumn("_start", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    start, last = F.col("_start"), F.col("_start") + F.col("_c") - 1

    def target(p: float) -> Column:
        at = (F.col("_n") - 1) * F.lit(p)
        return F.struct(F.lit(p).alias("prob"), F.floor(at).alias("lo"), F.ceil(at).alias("hi"), (at - F.floor(at)).alias("frac"))

    def value_at(place: Column) -> Column:
        """The value at a rank that this row holds; one in the middle of a gap would mean a sketch beyond its error."""
        missed = F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")
        known = F.when((place == start) | ~F.col("_gap"), F.col("_min")).when(place == last, F.col("_max")).otherwise(missed)
        return F.when(place.between(start, last), known)

    hits = F.filter(F.array(*[target(p) for p in p_list]), lambda t: t["lo"].between(start, last) | t["hi"].between(start, last))
    picked = placed.select(*group, "_c", "_gap", "_min", "_max", "_start", F.explode(hits).alias("_t"))
    low, high = F.max(value_at(F.col("_t.lo"))), F.max(value_at(F.col("_t.hi")))
    out = picked.groupBy(*group, F.col("_t.prob").alias("prob")).agg((low + (high - low) * F.max("_t.frac")).alias("value"))
    return out.select(*group, "prob", "value")


def interval_summary(df: DataFrame, col: str, group: Sequence[str] = (), q: float = 0.95, tail: str | None = "auto", null: float = 0.0) -> DataFrame:
    """Mean, two-sided interval, half-width, add-one p-value and standard error of replicates or samples.

    ``tail='upper'`` counts values >= null, ``'lower'`` values <= null, and
    ``'auto'`` the side away from the mean. Groups may be of any size: the ends
    of the interval are exact quantiles, found without gathering a group.
    """
    margin, group = (1 - q) / 2, list(group)
    c = F.col(col)
    upper = (F.count_if(c >= null) + 1) / (F.count(c) + 1)
    lower = (F.count_if(c <= null) + 1) / (F.count(c) + 1)
    p = {"upper": upper, "lower": lower}.get(tail, F.when(F.avg(c) > null, lower).otherwise(upper))
    keys = [F.col(g) for g in group] or [F.lit(0).alias("_all")]
    moments = df.groupBy(*keys).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), p.alias("p"), sem(col).alias("sem"))
    ends = quantiles(df, col, [margin, 1 - margin], group).groupBy(*keys).agg(
        F.max(F.when(F.col("prob") == margin, F.col("value"))).alias("lower"), F.max(F.when(F.col("prob") == 1 - margin, F.col("value"))).alias("upper")
    )
    names = group or ["_all"]
    same = [F.col(f"m.{k}").eqNullSafe(F.col(f"e.{k}")) for k in names]
    out = moments.alias("m").join(ends.alias("e"), same, "left").select(*[f"m.{g}" for g in group], "n", "mean", "lower", "upper", "p", "sem")
    return out.withColumn("half_width", half_width(F.col("mean"), F.col("lower"), F.col("upper")))


def half_width(mean: Column, lower: Column, upper: Column) -> Column:
    return F.greatest(mean - lower, upper - mean)


def sem(col: str) -> Column:
    """Standard error of the mean."""
    return F.stddev_samp(col) / F.sqrt(F.count(col))


def correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(a, b, corr) for the given pairs, in one pass over pairwise complete rows."""
    row = df.agg(*[F.corr(a, b).alias(f"_c{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.inline(F.array(*cells)))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, corr) for every unordered pair of columns."""
    return correlations(df, list(combinations(cols, 2)))


def weighted_means(df: DataFrame, cols: Sequence[str], weight: str, group: Sequence[str]) -> DataFrame:
    return df.groupBy(*group).agg(*[weighted_mean(F.col(c), F.col(weight)).alias(c) for c in cols])


def last_values(df: DataFrame, cols: Sequence[str], region: str = "region", date: str = "date") -> DataFrame:
    """Each column's last non-missing value per region."""
    return df.groupBy(region).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(date))).alias(c) for c in cols])


def first_values(df: DataFrame, cols: Sequence[str], region: str = "region", date: str = "date") -> DataFrame:
    """Each column's first non-missing value per region."""
    return df.groupBy(region).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(date))).alias(c) for c in cols])


def shares(df: DataFrame, col: str, out: str = "share") -> DataFrame:
    """Adds each row's part of the column total."""
    return df.withColumn(out, ratio(F.col(col), df.agg(F.sum(col)).scalar()))


def change_between(df: DataFrame, cols: Sequence[str], first: Column, last: Column, date: str = "date") -> DataFrame:
    """Sum on the last date minus sum on the first, per column."""

    def at(c: str, day: Column) -> Column:
        return F.sum(F.when(F.col(date) == day, F.col(c)))

    return df.agg(*[(at(c, last) - at(c, first)).alias(c) for c in cols])


def log_histogram(df: DataFrame, col: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts in ``bins`` equal steps of log10 between 10**lo and 10**hi; the last bin includes its upper end."""
    step = (hi - lo) / bins
    place = F.floor((F.log10(col) - lo) / step)
    inside = df.where((F.col(col) > 0) & F.log10(col).between(lo, hi))
    return inside.groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def highest_density(df: DataFrame, value: str, group: Sequence[str], tie: Sequence[str], prob: float = 0.95) -> DataFrame:
    """(group, lower, upper): the narrowest interval holding ``prob`` of the draws, the lowest on a tie."""
    group = list(group)
    placed = positions(df.select(*group, *tie, value), value, group, tie)
    starts = placed.select(*group, F.col(value).alias("_lo"), (F.col("pos") + F.floor(F.col("n") * prob)).alias("pos"))
    ends = placed.select(*group, F.col(value).alias("_hi"), "pos")
    spans = starts.join(ends, [*group, "pos"])
    best = F.min(F.struct((F.col("_hi") - F.col("_lo")).alias("w"), F.col("_lo"), F.col("_hi")))
    out = spans.groupBy(*group).agg(best.alias("_b"))
    return out.select(*group, F.col("_b._lo").alias("lower"), F.col("_b._hi").alias("upper"))


def _spreads(df: DataFrame, value: str, group: Sequence[str]) -> DataFrame:
    """(group, _min, _max, _bw): range and kernel bandwidth std * n**(-1/5) of groups whose values differ."""
    return df.groupBy(*group).agg(
        F.min(value).alias("_min"), F.max(value).alias("_max"),
        (F.stddev_samp(value) * F.pow(F.count(value).cast("double"), F.lit(-0.2))).alias("_bw"),
    ).where(F.col("_bw") > 0)


def _curve(rows: DataFrame, value: str, group: Sequence[str], points: int, cut: float) -> DataFrame:
    """Kernel density from (group, value, _c) rows that carry their group's spread, one sum per grid point."""
    lo, hi = F.col("_min") - cut * F.col("_bw"), F.col("_max") + cut * F.col("_bw")
    at = [lo + (hi - lo) * i / (points - 1) for i in range(points)]
    width = F.col("_bw") * (2 * pi) ** 0.5

    def kernel(x: Column) -> Column:
        z = (x - F.col(value)) / F.col("_bw")
        return F.col("_c") * F.exp(-0.5 * z * z) / width

    # one sum per grid point: no draw is multiplied by the grid
    sums = rows.groupBy(*group).agg(
        F.first(lo).alias("_lo"), F.first(hi).alias("_hi"), F.sum("_c").alias("_n"), *[F.sum(kernel(x)).alias(f"_d{i}") for i, x in enumerate(at)]
    )
    grid = F.transform(
        F.array(*[f"_d{i}" for i in range(points)]),
        lambda d, i: F.struct(i.alias("i"), (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * i / (points - 1)).alias("x"), (d / F.col("_n")).alias("density")),
    )
    return sums.select(*group, F.inline(grid))


def density(df: DataFrame, value: str, group: Sequence[str], points: int = 200, cut: float = 3.0) -> DataFrame:
    """(group, i, x, density): Gaussian kernel density on an even grid, bandwidth std * n**(-1/5).

    Every grid point is one sum over the group's draws, combined on the map side.
    """
    if not group:
        return density(df.withColumn("_all", F.lit(0)), value, ["_all"], points, cut).drop("_all")
    group = list(group)
    stats = _spreads(df, value, group)
    # equal draws weigh in as one row with a count, spread by value and not by group
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    return _curve(salted_join(counts, stats, group, spread=[value]), value, group, points, cut)


def binned_density(df: DataFrame, value: str, group: Sequence[str], points: int = 200, cut: float = 3.0, per_bandwidth: int = 32) -> DataFrame:
    """(group, i, x, density, max_error): ``density`` by linear binning.

    A draw is one addition: it divides its weight between the two nearest of
    evenly spaced nodes, ``per_bandwidth`` to a bandwidth, before anything is
    shuffled. Kernels are then summed over the nodes that hold weight, so the
    work per draw does not depend on the grid. The kernel is interpolated
    linearly between nodes, which changes no density by more than ``max_error``,
    (1 / per_bandwidth)**2 / 8 of the highest value one kernel takes.
    """
    if not group:
        return binned_density(df.withColumn("_all", F.lit(0)), value, ["_all"], points, cut, per_bandwidth).drop("_all")
    group = list(group)
    stats = cut_lineage(_spreads(df, value, group))
    draws = beside(df.where(F.col(value).isNotNull()).select(*group, value), stats, group, spread=[value])
    at = (F.col(value) - F.col("_min")) / F.col("_bw") * per_bandwidth
    placed = draws.select(*group, F.floor(at).alias("_node"), (at - F.floor(at)).alias("_part"))
    nodes = placed.groupBy(*group, "_node").agg(F.sum(1 - F.col("_part")).alias("_near"), F.sum("_part").alias("_far"))
    weights = nodes.select(*group, F.inline(F.array(F.struct("_node", F.col("_near").alias("_c")), F.struct((F.col("_node") + 1).alias("_node"), F.col("_far").alias("_c")))))
    rows = beside(weights.where("_c > 0"), stats, group, spread=["_node"]).withColumn("_x", F.col("_min") + F.col("_node") * F.col("_bw") / per_bandwidth)
    curve = beside(_curve(rows, "_x", group, points, cut), stats.select(*group, "_bw"), group, spread=["i"])
    return curve.select(*group, "i", "x", "density", (1 / (8 * per_bandwidth**2 * (2 * pi) ** 0.5) / F.col("_bw")).alias("max_error"))


def explained_variance(y: Column, y_hat: Column) -> Column:
    """1 - var(y - y_hat) / var(y)."""
    return 1 - ratio(F.var_pop(y - y_hat), F.var_pop(y))


def standard_scaled(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / population standard deviation; a constant column becomes 0."""
    one = df.agg(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in cols])).scalar()

    def scaled(c: str) -> Column:
        m, s = one.getField(c).getField("m"), one.getField(c).getField("s")
        return (F.col(c) - m) / F.coalesce(F.nullif(s, F.lit(0.0)), F.lit(1.0))

    return df.withColumns({c: scaled(c) for c in cols})


def min_max_scaled(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - min) / (max - min); a constant column becomes 0."""
    one = df.agg(F.struct(*[F.struct(F.min(c).cast("double").alias("a"), F.max(c).cast("double").alias("b")).alias(c) for c in cols])).scalar()

    def scaled(c: str) -> Column:
        a, b = one.getField(c).getField("a"), one.getField(c).getField("b")
        return (F.col(c) - a) / F.coalesce(F.nullif(b - a, F.lit(0.0)), F.lit(1.0))

    return df.withColumns({c: scaled(c) for c in cols})


def total_log_likelihood(df: DataFrame, keys: Sequence[str] = ("chain", "draw", "obs")) -> DataFrame:
    """Pointwise log-likelihood summed over variables, from rows (variable, keys, ll)."""
    return df.groupBy(*keys).agg(F.sum("ll").alias("total_ll"))


def count_distincts(df: DataFrame, cols: Mapping[str, str]) -> DataFrame:
    return df.agg(*[F.count_distinct(c).alias(n) for c, n in cols.items()])
