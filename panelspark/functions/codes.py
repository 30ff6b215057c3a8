"""Region codes and small numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad_code(code: Column, width: int = 5) -> Column:
    """Zero-padded code; a longer one stays whole."""
    text = code.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), "0")


def state_of(code: Column) -> Column:
    return F.floor(code / 1000).cast("int")


def code_from_geo_id(geo_id: Column) -> Column:
    return F.right(geo_id, F.lit(5)).cast("int")


def joined_code(state: Column, county: Column) -> Column:
    return F.concat(state, county).cast("int")


def floor_at(c: Column, floor: float = 1e-5) -> Column:
    """Values <= 0 become ``floor``; small positive values stay."""
    return F.when(c <= 0, F.lit(floor)).otherwise(c)


def median3(a: Column, b: Column, c: Column) -> Column:
    """Median of three, NULL if any is missing."""
    return a + b + c - F.greatest(a, b, c) - F.least(a, b, c) + F.when(a.isNull() | b.isNull() | c.isNull(), None).otherwise(0)


def blend_lag1(a: Column, a_lag8: Column) -> Column:
    """Value one day back, by the straight line between today and eight days ago."""
    return a - (a - a_lag8) * F.lit(1 / 8)


def risk_unprotected(delta: Column, n: Column, v: Column, c: Column, efficacy: float) -> Column:
    """Chance of an event among the unprotected, given ``delta`` new events in all."""
    at_risk = n - c
    mix = F.try_divide(v, at_risk) * F.lit(1 - efficacy) + F.try_divide(n - c - v, at_risk)
    return F.try_divide(F.try_divide(delta, at_risk), mix)
