"""Region attributes, outside time series, and the assembled panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions import codes
from panelspark.functions.nulls import inf_to_null, ratio
from panelspark.operators.panel import complete_regions, running_total, total_over_time
from panelspark.operators.stats import quantiles


def attach_attributes(regions: DataFrame, tables: Sequence[DataFrame], region: str = "region") -> DataFrame:
    """Left-joins attribute tables, each unique on region; Spark broadcasts the ones it measures as small."""
    out = regions
    for t in tables:
        out = out.join(t, region, "left")
    return out


def population_table(raw: DataFrame, extra: Sequence[tuple[int, int]] = ()) -> DataFrame:
    """All-string census rows (STATE, COUNTY, POPESTIMATE2020) as (region, population), plus rows given by hand."""
    table = raw.select(
        codes.joined_code(F.col("STATE"), F.col("COUNTY")).alias("region"),
        F.col("POPESTIMATE2020").cast("int").alias("population"),
    )
    if extra:
        table = table.unionByName(raw.sparkSession.createDataFrame(list(extra), "region int, population int"))
    return table


def gini_table(raw: DataFrame) -> DataFrame:
    """Gini file with a second header line, which is the row without a numeric estimate."""
    est = F.expr("try_cast(B19083_001E as double)")
    rows = raw.withColumn("gini", est).where(F.col("gini").isNotNull())
    return rows.select(codes.code_from_geo_id(F.col("GEO_ID")).alias("region"), "gini")


def vaccination_table(raw: DataFrame, blank_state: int | None = None, blank_before: str | None = None, drop_state: int | None = None) -> DataFrame:
    """Cumulative vaccinations with a numeric region code, a fraction in place of a percent, and known bad values blanked."""
    t = raw.select(
        F.to_date("Date", "MM/dd/yyyy").alias("date"),
        F.expr("try_cast(FIPS as int)").alias("region"),
        (F.col("Series_Complete_Pop_Pct") / 100).alias("fraction_vaccinated"),
        F.col("Series_Complete_Yes").alias("cumulative_vaccinations"),
    ).where(F.col("region").isNotNull())
    t = t.withColumn("state", codes.state_of(F.col("region")))
    if drop_state is not None:
        t = t.where(F.col("state") != drop_state)
    if blank_state is not None:
        t = blank_out(t, ["fraction_vaccinated", "cumulative_vaccinations"], blank_state, blank_before)
    return t


def blank_out(df: DataFrame, cols: Sequence[str], state: int, before: str, date: str = "date") -> DataFrame:
    """NULLs the columns of one state before a date."""
    bad = (F.col("state") == state) & (F.col(date) < F.lit(before).cast("date"))
    return df.withColumns({c: F.when(bad, None).otherwise(F.col(c)) for c in cols})


def wide_to_long(df: DataFrame, ids: Sequence[str], value: str, date: str = "date", keep: Mapping[str, str] | None = None) -> DataFrame:
    """One column per ISO date to rows (ids, date, value)."""
    days = [c for c in df.columns if c not in ids]
    long = df.unpivot(list(ids), days, date, value).withColumn(date, F.to_date(date))
    if keep is None:
        return long
    return long.select(*[F.col(c).alias(n) for c, n in keep.items()], date, value)


def log_transforms(
    df: DataFrame,
    log_cols: Sequence[str],
    complement_cols: Sequence[str] = (),
) -> DataFrame:
    """log2(x + median/100) as ``x_log`` and log2(100) - log2(100 - x) as ``x_neglog``; the originals go."""
    present = [c for c in log_cols if c in df.columns]
    new = {}
    if present:
        # all medians in one pass over the columns as rows, brought back as one map
        long = df.select([F.col(c).cast("double").alias(c) for c in present]).unpivot([], present, "_column", "_value")
        medians = quantiles(long, "_value", [0.5], ["_column"])
        found = medians.agg(F.map_from_entries(F.collect_list(F.struct("_column", "value")))).scalar()
        new = {f"{c}_log": inf_to_null(F.log2(F.col(c) + F.element_at(found, F.lit(c)) / 100)) for c in present}
    for c in complement_cols:
        new[f"{c}_neglog"] = inf_to_null(F.log2(F.lit(100.0)) - F.log2(100 - F.col(c)))
    return df.withColumns(new).drop(*present, *complement_cols)


def assemble_panel(
    base: DataFrame,
    activity: DataFrame,
    deaths: DataFrame,
    cases: DataFrame,
    regions: DataFrame,
    first: str,
    before: str,
    measures: Mapping[str, str],
    last_state: int = 56,
    copy_counts: bool = False,
) -> DataFrame:
    """Outer-joins the daily tables, keeps regions in real states and dates in [first, before), and accumulates.

    ``base`` carries ``state``; rows without one, or outside 1..last_state, go.
    Only the regions with the most dates stay. ``measures`` maps the daily
    counts to the names of their running totals; a missing count is 0.
    """
    key = ["region", "date"]
    df = base.join(activity, key, "full").join(deaths, key, "full").join(cases, key, "full")
    df = df.join(regions, "region")
    df = df.where(F.col("state").isNotNull() & F.col("state").between(1, last_state))
    df = df.where((F.col("date") >= F.lit(first).cast("date")) & (F.col("date") < F.lit(before).cast("date")))
    df = complete_regions(df).fillna(0, subset=list(measures))
    if copy_counts:
        df = df.withColumns({"n_flagged_refs": F.col("n_flagged"), "n_refs": F.col("n_events")})
    return total_over_time(running_total(df, measures), "n_events", "n_events_all_time")


def coverage(tables: Mapping[str, DataFrame], region: str = "region") -> DataFrame:
    """(source, code): the padded codes of the regions each table covers."""
    parts = [t.select(F.lit(name).alias("source"), codes.pad_code(F.col(region)).alias("code")).distinct() for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rate_map(panel: DataFrame, measure: str, population: str = "population", per_last_row: bool = False) -> DataFrame:
    """Padded code, last cumulative value per head and day, and its log10.

    Days are the panel's distinct dates; ``per_last_row=True`` counts the
    distinct dates of the regions' last rows only.
    """
    n_days = panel.agg(F.count_distinct("date")).scalar()
    rows = panel.groupBy("region").agg(
        F.max_by(measure, F.when(F.col(measure).isNotNull(), F.col("date"))).alias("m"),
        F.max_by(population, F.when(F.col(population).isNotNull(), F.col("date"))).alias("p"),
        F.max("date").alias("d"),
    )
    if per_last_row:
        n_days = rows.agg(F.count_distinct("d")).scalar()
    out = rows.withColumn("rate", ratio(F.col("m").cast("double"), F.col("p") * n_days))
    return out.select(codes.pad_code(F.col("region")).alias("code"), "rate", F.log10("rate").alias("rate_log"))
