"""Operators on a panel: a table with one row per (region, date).

A region's series holds at most one row per calendar day, which bounds every
window partition and every collected series below. All windows partition by
region and order by day number, so chained operators share one exchange.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.nulls import ratio
from panelspark.operators.stats import quantiles


def day_number(date: str = "date") -> Column:
    return F.unix_date(F.col(date))


def _series(region: str, date: str, reverse: bool = False) -> W:
    day = day_number(date)
    return W.partitionBy(region).orderBy(day.desc() if reverse else day.asc())


def _so_far(region: str, date: str, reverse: bool = False) -> W:
    return _series(region, date, reverse).rowsBetween(W.unboundedPreceding, W.currentRow)


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows; running it fails if a key repeats."""
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    checked = F.when(n > 1, F.raise_error(F.lit(f"rows are not unique on {list(keys)}"))).otherwise(F.lit(True))
    return df.withColumn("_unique", checked.cast("boolean")).where("_unique").drop("_unique")


def fill_calendar(
    df: DataFrame,
    regions: DataFrame,
    zero: Sequence[str],
    region: str = "region",
    date: str = "date",
    bounds: DataFrame | None = None,
) -> DataFrame:
    """One row per region of ``regions`` and day between the first and last date; missing measures become 0.

    Each region makes its own days, so no pair of tables is multiplied. The
    columns of ``regions`` stay. ``bounds`` names another table to take the
    first and last date from.
    """
    source = df if bounds is None else bounds
    span = source.agg(F.struct(F.min(date).alias("a"), F.max(date).alias("b"))).scalar()
    days = regions.withColumn(date, F.explode(F.sequence(span.getField("a"), span.getField("b"))))
    return days.join(df, [region, date], "left").fillna(0, subset=list(zero))


def running_total(df: DataFrame, cols: Mapping[str, str], region: str = "region", date: str = "date") -> DataFrame:
    """Adds cumulative sums over time; ``cols`` maps a measure to the name of its total."""
    w = _so_far(region, date)
    return df.withColumns({name: F.sum(c).over(w) for c, name in cols.items()})


def calendar_lag(
    df: DataFrame,
    cols: Sequence[str],
    lags: Sequence[int] = (1,),
    drop: bool = False,
    suffix: str = "",
    region: str = "region",
    date: str = "date",
) -> DataFrame:
    """Adds the value L days earlier for every column and lag; rows without all lagged days are dropped.

    All lags share one window specification per offset and thus one exchange
    and one sort. A repeated (region, date) raises.
    """
    day = "_day"
    w = W.partitionBy(region).orderBy(day)
    base = df.withColumn(day, day_number(date))
    here = F.count(F.lit(1)).over(w.rangeBetween(0, 0))
    added, present = [], []
    for lag in lags:
        frame = w.rangeBetween(-lag, -lag)
        present.append(F.count(F.lit(1)).over(frame) > 0)
        added += [F.max(c).over(frame).alias(f"{c}_tlag{lag}{suffix}") for c in cols]
    once = F.when(here > 1, F.raise_error(F.lit("a region has two rows on one date"))).otherwise(F.lit(True))
    keep = once.cast("boolean")
    for p in present:
        keep = keep & p
    out = base.select(*[f"`{c}`" for c in df.columns if not (drop and c in cols)], *added, keep.alias("_keep"))
    return out.where("_keep").drop("_keep")


def rate_of_change(
    df: DataFrame,
    cols: Sequence[str],
    lags: Sequence[int] = (1,),
    drop: bool = False,
    region: str = "region",
    date: str = "date",
) -> DataFrame:
    """Adds (x - x L days ago) / L as ``x_dxdtL``."""
    lagged = calendar_lag(df, cols, lags, suffix="_prev", region=region, date=date)
    rates = [((F.col(f"`{c}`") - F.col(f"`{c}_tlag{n}_prev`")) / n).alias(f"{c}_dxdt{n}") for n in lags for c in cols]
    return lagged.select(*[f"`{c}`" for c in df.columns if not (drop and c in cols)], *rates)


def per_capita(df: DataFrame, cols: Sequence[str], population: str = "population", drop: bool = False) -> DataFrame:
    kept = [c for c in df.columns if not (drop and c in cols)]
    return df.select(*kept, *[ratio(F.col(c), F.col(population)).alias(f"{c}_per_capita") for c in cols])


def is_monotonic(df: DataFrame, cols: Sequence[str], region: str = "region", date: str = "date") -> DataFrame:
    """Per region: does each column never fall? A missing value counts as a fall, a single row never falls."""
    w = _series(region, date)
    steps = df.select(
        region,
        F.row_number().over(w).alias("_i"),
        *[F.coalesce(F.col(c) >= F.lag(c).over(w), F.lit(False)).alias(c) for c in cols],
    )
    return steps.groupBy(region).agg(*[F.bool_and(F.col(c) | (F.col("_i") == 1)).alias(c) for c in cols])


def make_monotonic(
    df: DataFrame,
    cols: Sequence[str],
    epsilon: float = 0.0,
    prioritize_last: bool = True,
    region: str = "region",
    date: str = "date",
) -> DataFrame:
    """Repairs falling steps. With ``prioritize_last`` later values win, else earlier ones.

    Without epsilon a running minimum (from the end) or maximum does it. With
    epsilon a repaired value lies epsilon below (above) its fixed neighbour,
    which depends on the neighbour's own repair: one fold over the sorted series
    of a region, which has at most one row per calendar day; a repeated day raises.
    """
    if epsilon == 0:
        w = _so_far(region, date, reverse=prioritize_last)
        extreme = F.min if prioritize_last else F.max
        # a missing value takes its repaired neighbour; a missing fixed end leaves the whole series missing
        return df.withColumns({c: F.when(F.first(c).over(w).isNotNull(), extreme(c).over(w)) for c in cols})

    kinds = [T.StructField(f.name, T.DoubleType()) if f.name in cols else f for f in df.schema]
    sign = 1.0 if prioritize_last else -1.0

    def repaired(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(date)
        if pc.count_distinct(rows[date], mode="all").as_py() < rows.num_rows:
            raise ValueError("a series has a date more than once")
        for c in cols:
            x = [None if v is None else sign * float(v) for v in rows[c].to_pylist()]
            fixed, near = [], None
            for k, v in enumerate(reversed(x) if prioritize_last else x):
                if k and near is None:
                    v = None
                elif k and (v is None or v >= near):
                    v = near - epsilon
                near = v
                fixed.append(None if v is None else sign * v)
            rows = rows.set_column(rows.column_names.index(c), c, pa.array(fixed[::-1] if prioritize_last else fixed, pa.float64()))
        return rows

    return df.groupBy(region).applyInArrow(repaired, T.StructType(kinds)).select(*df.columns)


def _collect_series(df: DataFrame, region: str, date: str) -> DataFrame:
    """One row per region with its rows as a date-ordered array (at most one entry per calendar day)."""
    rest = [c for c in df.columns if c not in (region, date)]
    series = df.groupBy(region).agg(F.array_sort(F.collect_list(F.struct(date, *rest))).alias("_s"))
    dates = F.transform("_s", lambda s: s[date])
    return series.withColumn("_s", F.when(F.size(F.array_distinct(dates)) == F.size(dates), F.col("_s")).otherwise(F.raise_error(F.lit("a series has a date more than once"))))


def _explode_series(arrays: DataFrame, columns: Sequence[str], new: Mapping[str, Column], region: str) -> DataFrame:
    """Back to one row per date, with the columns in ``new`` replaced by the given arrays."""
    names = {c: f"_a{i}" for i, c in enumerate(new)}
    zipped = F.arrays_zip("_s", *names.values())
    rows = arrays.withColumns({names[c]: a for c, a in new.items()}).select(region, F.explode(zipped).alias("_r"))

    def pick(c: str) -> Column:
        if c == region:
            return F.col(region)
        return (F.col(f"_r.{names[c]}") if c in names else F.col(f"_r._s.{c}")).alias(c)

    return rows.select(*[pick(c) for c in columns])


def polynomial_fit_rows(window: int, order: int) -> np.ndarray:
    """Row r holds the weights that give, at place r of the window, the least-squares polynomial through it."""
    x = np.arange(window) - window // 2
    a = np.vander(x, order + 1, increasing=True).astype(float)
    return a @ np.linalg.pinv(a)


def smooth(
    df: DataFrame,
    cols: Sequence[str],
    window: int = 9,
    order: int = 1,
    drop_ends: bool = False,
    region: str = "region",
    date: str = "date",
) -> DataFrame:
    """Polynomial smoothing over a moving window; the ends follow the polynomial of the first or last full window.

    An even window is made odd and a window of 1 changes nothing. A series
    shorter than the window raises. ``drop_ends`` drops the first and last
    ``window`` dates of the panel.
    """
    if window % 2 == 0:
        window += 1
    if window == 1:
        return df
    fit = polynomial_fit_rows(window, order)
    weights = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in fit])
    half = window // 2
    arrays = _collect_series(df, region, date)
    n = F.size("_s")

    def smoothed(c: str) -> Column:
        def fitted(x: Column) -> Column:
            def at(_: Column, i: Column) -> Column:
                start = F.least(F.greatest(i - half, F.lit(0)), n - window)
                terms = F.zip_with(F.get(weights, i - start), F.slice(x, start + 1, window), lambda a, b: a * b)
                return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)

            return F.transform(x, at)

        short = F.raise_error(F.lit("a series is shorter than the smoothing window")).cast("array<double>")
        # the outer one-element array binds the series, which would else be rebuilt for every place in it
        bound = F.array(F.transform("_s", lambda s: s[c].cast("double")))
        return F.when(n < window, short).otherwise(F.get(F.transform(bound, fitted), F.lit(0)))

    out = _explode_series(arrays, df.columns, {c: smoothed(c) for c in cols}, region)
    if not drop_ends:
        return out
    dates = df.select(date).distinct()
    w = W.orderBy(date)  # distinct dates only: bounded by the calendar
    back = W.orderBy(F.col(date).desc())
    inner = dates.select(date, F.row_number().over(w).alias("_a"), F.row_number().over(back).alias("_b"))
    return out.join(inner.where((F.col("_a") > window) & (F.col("_b") > window)).select(date), date, "left_semi").select(*df.columns)


def interpolate(
    df: DataFrame,
    col: str,
    by: str = "position",
    edges: str = "null",
    region: str = "region",
    date: str = "date",
) -> DataFrame:
    """Linear interpolation of missing values between their neighbours in date order.

    Distance is counted in rows, or in days with ``by='date'``. A gap at either
    end of a series stays NULL, or raises with ``edges='raise'``.
    """
    place = F.row_number().over(_series(region, date)) if by == "position" else day_number(date)
    base = df.withColumn("_p", place)
    known = F.when(F.col(col).isNotNull(), F.struct(F.col("_p").alias("p"), F.col(col).cast("double").alias("v")))
    # looking back along either direction keeps both frames linear in the series length
    marked = base.withColumns(
        {
            "_a": F.last(known, ignorenulls=True).over(_so_far(region, date)),
            "_b": F.last(known, ignorenulls=True).over(_so_far(region, date, reverse=True)),
        }
    )
    slope = F.try_divide(F.col("_p") - F.col("_a.p"), F.col("_b.p") - F.col("_a.p"))
    filled = F.coalesce(F.col(col).cast("double"), F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * slope)
    if edges == "raise":
        filled = F.coalesce(filled, F.raise_error(F.lit("a gap at the end of a series cannot be interpolated")).cast("double"))
    return marked.withColumn(col, filled).select(*df.columns)


def expand_dates(panel: DataFrame, sparse: DataFrame, region: str = "region", date: str = "date") -> DataFrame:
    """The panel's (region, date) rows inside the sparse table's date range and regions, left-joined with it."""
    span = sparse.agg(F.struct(F.min(date).alias("a"), F.max(date).alias("b"))).scalar()
    rows = panel.where((F.col(date) >= span.getField("a")) & (F.col(date) <= span.getField("b")))
    rows = rows.join(sparse.select(region).distinct(), region, "left_semi")
    extra = [c for c in sparse.columns if c in (region, date) or c not in panel.columns]
    return rows.join(sparse.select(*extra), [region, date], "left")


def time_index(df: DataFrame, out: str = "t", date: str = "date") -> DataFrame:
    """Adds the rank of the date among the distinct dates, from 0."""
    dates = df.select(date).distinct()  # bounded by the calendar, so one window task is enough
    ranks = dates.select(date, (F.row_number().over(W.orderBy(date)) - 1).alias(out))
    return df.join(ranks, date).select(*df.columns, out)


def thin_dates(
    df: DataFrame,
    measure: str,
    step: int = 8,
    n: int = 24,
    before: str | None = None,
    region: str = "region",
    date: str = "date",
) -> DataFrame:
    """Rows on every ``step``-th date counted back from the last one, the earliest ``n`` of those, before a cut-off.

    Only dates on which the median of ``measure`` is above 0 are counted.
    """
    per_date = quantiles(df, measure, [0.5], [date]).where("value > 0")
    back = F.row_number().over(W.orderBy(F.col(date).desc()))
    kept = per_date.withColumn("_r", back).where((F.col("_r") - 1) % step == 0).select(date)
    kept = kept.orderBy(date).limit(n)
    if before is not None:
        kept = kept.where(F.col(date) < F.lit(before).cast("date"))
    return df.join(kept, date, "left_semi").select(*df.columns)


def compartments(
    df: DataFrame,
    population: str = "population",
    vaccinated: str = "cumulative_vaccinations",
    deaths: str = "cumulative_deaths",
    cases: str = "cumulative_cases",
    produced: str = "cumulative_flagged",
    recovery: int = 8,
    region: str = "region",
    date: str = "date",
) -> DataFrame:
    """Adds N, V, D, C, R (cases ``recovery`` days ago), I = C - R, S = N - (C + V) and T_a."""
    named = df.withColumns(
        {"N": F.col(population), "V": F.col(vaccinated), "D": F.col(deaths), "C": F.col(cases), "T_a": F.col(produced)}
    )
    lagged = calendar_lag(named, ["C"], [recovery], region=region, date=date).withColumnRenamed(f"C_tlag{recovery}", "R")
    return lagged.withColumns({"I": F.col("C") - F.col("R"), "S": F.col("N") - (F.col("C") + F.col("V"))})


def interactions(df: DataFrame, a: str = "A") -> DataFrame:
    """Adds S*I, S*(1-A), 1-A and a constant."""
    one_less = 1 - F.col(a)
    return df.withColumns({"SxI": F.col("S") * F.col("I"), "Sx1mA": F.col("S") * one_less, "1mA": one_less, "const": F.lit(1)})


def saturating_accumulation(
    df: DataFrame,
    start: str,
    gain: str,
    out: str = "A",
    step: float = 8.0,
    region: str = "region",
    date: str = "date",
) -> DataFrame:
    """A_t = A_{t-1} + step * g_t * (1 - A_{t-1}) from A_0 = ``start`` on each region's first row.

    1 - A is a running product of (1 - step * g). It is split into sign, zero
    and log-magnitude parts, each of which is a plain running sum.
    """
    w = _so_far(region, date)
    first = F.row_number().over(_series(region, date)) == 1
    factor = F.when(first, F.lit(1.0)).otherwise(1 - step * F.col(gain))
    base = df.withColumn("_f", factor)
    f = F.col("_f")
    size = F.exp(F.sum(F.when(f == 0, F.lit(0.0)).otherwise(F.ln(F.abs(f)))).over(w))
    flips = F.sum((f < 0).cast("int")).over(w)
    zeros = F.sum((f == 0).cast("int")).over(w)
    product = F.when(zeros > 0, F.lit(0.0)).when(flips % 2 == 1, -size).otherwise(size)
    a0 = F.first(start).over(w)
    return base.withColumn(out, 1 - (1 - a0) * product).drop("_f")


def step_parameter(df: DataFrame, values: DataFrame, width: int, value: str, t: str = "t", bin_col: str = "bin") -> DataFrame:
    """Adds the parameter valid in time bin floor(t / width)."""
    binned = df.withColumn(bin_col, F.floor(F.col(t) / width))
    return binned.join(values.select(bin_col, value), bin_col, "left").select(*df.columns, value)


def national_daily(df: DataFrame, cols: Sequence[str], date: str = "date") -> DataFrame:
    """Daily totals over all regions with a rate of change per measure, treating the nation as one region."""
    totals = df.groupBy(date).agg(*[F.sum(c).alias(c) for c in cols]).withColumn("_nation", F.lit(0))
    return rate_of_change(totals, cols, region="_nation", date=date).drop("_nation")


def scaled_profile(df: DataFrame, cols: Sequence[str], region: str = "region") -> DataFrame:
    """Each column divided by its largest absolute value in the region."""
    w = W.partitionBy(region)
    return df.withColumns({c: ratio(F.col(c), F.max(F.abs(F.col(c))).over(w)) for c in cols})


def total_over_time(df: DataFrame, col: str, out: str, population: str = "population", region: str = "region") -> DataFrame:
    """Adds a region's total, the total per capita and its base-2 logarithm."""
    total = F.sum(col).over(W.partitionBy(region))
    out_df = df.withColumn(out, total).withColumn(f"{out}_per_capita", ratio(F.col(out), F.col(population)))
    return out_df.withColumn(f"{out}_per_capita_log", F.log2(f"{out}_per_capita"))


def cluster_profiles(df: DataFrame, cols: Sequence[str], cluster: str = "cluster", t: str = "t") -> DataFrame:
    """Mean of each attribute by cluster at the last time step, with the share of regions in it."""
    last = df.agg(F.max(t)).scalar()
    rows = df.where(F.col(t) == last)
    total = rows.agg(F.count(F.lit(1))).scalar()
    return rows.groupBy(cluster).agg((F.count(F.lit(1)) / total).alias("share"), *[F.avg(c).alias(c) for c in cols])


def relabel_clusters(df: DataFrame, cluster: str = "cluster", t: str = "t") -> DataFrame:
    """Clusters numbered from 0 by falling size at the first time step, ties by old number."""
    first = df.agg(F.min(t)).scalar()
    sizes = df.where(F.col(t) == first).groupBy(cluster).agg(F.count(F.lit(1)).alias("_n"))
    order = W.orderBy(F.col("_n").desc(), F.col(cluster))  # one row per cluster, never more than regions
    names = sizes.select(cluster, (F.row_number().over(order) - 1).alias("_new"))
    out = df.join(names, cluster, "left")
    return out.select(*[F.col("_new").alias(cluster) if c == cluster else F.col(c) for c in df.columns])


def complete_regions(df: DataFrame, region: str = "region") -> DataFrame:
    """Regions with as many rows as the best-covered one."""
    counts = df.groupBy(region).agg(F.count(F.lit(1)).alias("_n"))
    most = counts.agg(F.max("_n")).scalar()
    return df.join(counts.where(F.col("_n") == most), region, "left_semi").select(*df.columns)


def balance(df: DataFrame, region: str = "region", date: str = "date") -> DataFrame:
    """Row, region and date counts, and whether every region has every date."""
    out = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(region).alias("n_regions"),
        F.count_distinct(date).alias("n_dates"),
    )
    return out.withColumn("balanced", F.col("n_rows") == F.col("n_regions") * F.col("n_dates"))


def lag_array(df: DataFrame, col: str, lags: Sequence[int], out: str) -> DataFrame:
    """Packs a column and its lags into one array, lag 0 first."""
    return df.withColumn(out, F.array(col, *[f"{col}_tlag{n}" for n in lags]))
