"""Missing-value rules. Missing is NULL everywhere; NaN is turned into NULL at the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in any float column becomes NULL."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.nanvl(F.col(f"`{c}`"), F.lit(None)).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns])


def inf_to_null(c: Column) -> Column:
    return F.when(F.abs(c) == float("inf"), None).otherwise(c)


def sum0(c: Column) -> Column:
    """A sum that is 0 when every value is missing."""
    return F.coalesce(F.sum(c), F.lit(0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a, b)


def weighted_mean(x: Column, w: Column) -> Column:
    """Mean of x weighted by w; one missing value or weight makes it NULL."""
    complete = F.count(F.lit(1)) == F.count(x * w)
    return F.when(complete, F.try_divide(F.sum(x * w), F.sum(w)))


def same(a: Column, b: Column) -> Column:
    """Equality under which a missing value equals nothing."""
    return F.coalesce(a == b, F.lit(False))


def drop_missing(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Rows complete in ``subset`` (all columns by default), NaN counting as missing."""
    return df.dropna(how="any", subset=subset)
