"""The named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with the SQL it must agree with where there is one."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def day(c: str | Column = "date") -> Column:
    """A date as text, which every client renders alike."""
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd")


def shown(
    df: DataFrame,
    days: tuple[str, ...] = (),
    longs: tuple[str, ...] = (),
    strings: tuple[str, ...] = (),
    doubles: Mapping[str, int] | tuple[str, ...] = (),
    flags: tuple[str, ...] = (),
) -> DataFrame:
    """The output columns in plain types; doubles rounded to the given digits (6 by default)."""
    digits = doubles if isinstance(doubles, Mapping) else {c: 6 for c in doubles}
    return df.select(
        *[day(c).alias(c) for c in days],
        *[F.col(c).cast("bigint").alias(c) for c in longs],
        *[F.col(c).cast("string").alias(c) for c in strings],
        *[(F.round(F.col(c).cast("double"), d) + 0.0).alias(c) for c, d in digits.items()],
        *[F.col(c).cast("boolean").alias(c) for c in flags],
    )


def listed(
    days: tuple[str, ...] = (),
    longs: tuple[str, ...] = (),
    strings: tuple[str, ...] = (),
    doubles: Mapping[str, int] | tuple[str, ...] = (),
    flags: tuple[str, ...] = (),
) -> str:
    """The same column list in SQL."""
    digits = doubles if isinstance(doubles, Mapping) else {c: 6 for c in doubles}
    return ", ".join(
        [f'strftime("{c}", \'%Y-%m-%d\') AS "{c}"' for c in days]
        + [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in longs]
        + [f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in strings]
        + [f'round(CAST("{c}" AS DOUBLE), {d}) + 0.0 AS "{c}"' for c, d in digits.items()]
        + [f'CAST("{c}" AS BOOLEAN) AS "{c}"' for c in flags]
    )


RECURSIVE = "/* recursive */"


class Out:
    """One column list used on both sides of a comparison."""

    def __init__(self, **kinds: tuple[str, ...] | Mapping[str, int]) -> None:
        self.kinds = kinds

    def of(self, df: DataFrame) -> DataFrame:
        return shown(df, **self.kinds)

    def sql(self, ctes: str, source: str) -> str:
        kind = "RECURSIVE " if RECURSIVE in ctes else ""
        head = f"WITH {kind}{ctes.strip().rstrip(',')}\n" if ctes.strip() else ""
        return f"{head}SELECT {listed(**self.kinds)} FROM ({source})"
