"""Building blocks that stay balanced when one key or value holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.session import cut_lineage

# Rows of a table that may be broadcast; a few per task of a large cluster.
BROADCAST_ROWS = 20_000


def tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def small_rows(df: DataFrame) -> pa.Table | None:
    """The rows of a table that turns out to have no more than may be broadcast."""
    rows = df.limit(BROADCAST_ROWS + 1).toArrow()
    return rows if rows.num_rows <= BROADCAST_ROWS else None


def beside(big: DataFrame, keyed: DataFrame, on: Sequence[str], spread: Sequence[str] = (), rows: pa.Table | None = None) -> DataFrame:
    """``big`` with the columns of ``keyed``, which is unique on ``on``, missing keys being equal.

    A small ``keyed`` (its ``rows``, if known) is broadcast and nothing of
    ``big`` moves; a larger one is met in a join that spreads hot keys.
    """
    rows = rows or small_rows(keyed)
    if rows is None:
        return salted_join(big, cut_lineage(keyed), on, spread=spread, null_safe=True)
    known = big.sparkSession.createDataFrame(rows, keyed.schema)
    same = [F.col(f"b.{k}").eqNullSafe(F.col(f"k.{k}")) for k in on]
    return big.alias("b").join(F.broadcast(known.alias("k")), same).select("b.*", *[f"k.{c}" for c in keyed.columns if c not in on])


# Rows of a table that are looked at to find its hot keys.
SAMPLED = 1_000_000


def hot_keys(df: DataFrame, keys: Sequence[str], share: int | None = None) -> DataFrame:
    """(keys, _copies): keys holding at least 1/share of the rows, and into how many such parts theirs divide.

    By default a part is a quarter of what a shuffle task has on average, so a
    key that is left alone cannot make its task much longer than others. There
    are never more than ``share`` such keys, nor copies of all of them than twice
    that. They are found in a sample of about SAMPLED rows chosen by hash; all
    rows are read where there are no more.
    """
    share = share or 4 * tasks(df)
    rows = df.agg(F.count(F.lit(1))).scalar()
    some = df.where(F.pmod(F.xxhash64(*df.columns), F.greatest(F.lit(1), F.floor(rows / SAMPLED))) == 0)
    counts = some.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = some.agg(F.count(F.lit(1))).scalar()
    parts = F.col("_n") * share / total
    return counts.where(parts >= 1).select(*keys, (F.floor(parts) + 1).cast("int").alias("_copies"))


def salted_join(
    big: DataFrame,
    keyed: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] = (),
    share: int | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """Equi-join in which a hot key of ``big`` is spread over as many tasks as its share of the rows asks for.

    ``keyed`` is unique on ``on``; a row of it is copied once per part of its
    key's rows (see ``hot_keys``), so that all copies together are a few per
    shuffle task. ``spread`` names columns of ``big`` that differ within a hot
    key. The list of hot keys is bounded as well and is broadcast. A hot NULL is
    spread like any other key, also where it matches nothing.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"how={how!r} is not supported")
    on = list(on)
    hot = hot_keys(big, on, share)
    spread_cols = [F.col(c) for c in (spread or [c for c in big.columns if c not in on])]

    def same_keys(left: str, right: str, nulls: bool = null_safe) -> Column:
        cond = F.lit(True)
        for k in on:
            a, b = F.col(f"{left}.{k}"), F.col(f"{right}.{k}")
            cond = cond & (a.eqNullSafe(b) if nulls else a == b)
        return cond

    def with_copies(df: DataFrame) -> DataFrame:
        joined = df.alias("d").join(F.broadcast(hot.alias("h")), same_keys("d", "h", True), "left")
        return joined.select("d.*", F.coalesce("h._copies", F.lit(1)).alias("_copies"))

    left = with_copies(big).withColumn("_salt", F.pmod(F.xxhash64(*spread_cols), F.col("_copies")).cast("int")).drop("_copies")
    right = with_copies(keyed).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies")
    cond = same_keys("l", "r") & (F.col("l._salt") == F.col("r._salt"))
    out = left.alias("l").join(right.alias("r"), cond, how)
    cols = [F.col(f"l.{c}") for c in big.columns]
    if how != "left_semi":
        cols += [F.col(f"r.{c}") for c in keyed.columns if c not in on]
    return out.select(*cols)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the smallest by ``order``.

    A minimum combines on the map side, so copies of one key are reduced before
    the shuffle; a row_number window would gather them in one task. ``order``
    must be a total order within a key.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*order, *rest)
    out = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return out.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def in_order(df: DataFrame, order: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """A stored table of ``df`` in the order of ``group`` and ``order``, with ``_part`` and ``_place``.

    Spark's range partitioner deals the rows over the tasks and every task sorts
    its own; ``_part`` numbers the ranges in order and ``_place`` the rows of a
    range. What follows reads both from the table, so a range never moves again.
    """
    sort = [*group, *order]
    placed = df.repartitionByRange(tasks(df), *sort).sortWithinPartitions(*sort).withColumn("_id", F.monotonically_increasing_id())
    # the id is the partition in its upper bits and the row's number in the lower 33
    part, place = F.shiftright("_id", 33).cast("int"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return cut_lineage(placed.withColumns({"_part": part, "_place": place}).drop("_id"))


def positions(df: DataFrame, value: str, group: Sequence[str] = (), tie: Sequence[str] = (), out: str = "pos") -> DataFrame:
    """Zero-based position of each row in the order (value, tie) within its group, and the group size ``n``.

    Rows are sorted once in ranges; a row's position is its place in its range
    plus the sizes of the group's earlier ranges. The part of a group in a range
    is one row of the table of offsets, which has at most as many rows as there
    are ranges and groups. A frequent value is spread over ranges by ``tie``.
    Rows with a missing value are left out.
    """
    group = list(group)
    rows = in_order(df.where(F.col(value).isNotNull()), [value, *tie], group)
    parts = rows.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_size"), F.min("_place").alias("_first"))
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select(
        *group, "_part", (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_size").over(W.partitionBy(*group)).alias("n")
    )
    numbered = beside(rows, offsets, [*group, "_part"], spread=["_place"])
    return numbered.withColumn(out, F.col("_place") + F.col("_shift")).drop("_part", "_place", "_shift")


def prefix_sums(df: DataFrame, value: str, sums: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Adds ``<c>_below``, the sum of c over smaller values of the group, and ``<c>_all``, that over the whole group.

    (group, value) must be unique. Running sums are taken within the ranges of
    one sort and shifted by the totals of the group's earlier ranges.
    """
    group = list(group)
    rows = in_order(df, [value], group)
    cell = [*group, "_part"]
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy(*cell).agg(*[F.sum(c).alias(f"_{c}_total") for c in sums])
    totals = totals.select(
        *cell,
        *[F.coalesce(F.sum(f"_{c}_total").over(before), F.lit(0)).alias(f"_{c}_start") for c in sums],
        *[F.sum(f"_{c}_total").over(W.partitionBy(*group)).alias(f"{c}_all") for c in sums],
    )
    inside = W.partitionBy(*cell).orderBy("_place").rowsBetween(W.unboundedPreceding, -1)
    run = rows.withColumns({f"_{c}_in": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    joined = beside(run, totals, cell, spread=["_place"])
    return joined.select(*df.columns, *[(F.col(f"_{c}_start") + F.col(f"_{c}_in")).alias(f"{c}_below") for c in sums], *[f"{c}_all" for c in sums])
