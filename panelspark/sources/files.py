"""Readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.nulls import nan_to_null
from panelspark.sources import schemas


def read_posts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Raw posts, one JSON object per line, gzip or plain; a broken line fails the job."""
    return spark.read.schema(schemas.POSTS).option("mode", "FAILFAST").json(paths)


def read_json_lines(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)


def posts_between(spark: SparkSession, folder: str, first: str, last: str) -> DataFrame:
    """Raw posts of the days in [first, last] from a folder with one subfolder ``date=YYYY-MM-DD`` per day.

    The date is a partition column, so files of other days are never opened.
    """
    schema = f"{schemas.POSTS.strip()}, date DATE"
    posts = spark.read.schema(schema).option("mode", "FAILFAST").option("basePath", folder).json(folder)
    return posts.where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def read_delimited(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", columns: Sequence[str] | None = None) -> DataFrame:
    """CSV, semicolon or tab files with a header; NaN becomes NULL.

    With ``columns`` the file is matched by header name and read as text, then
    cast to ``schema``, so extra columns in the file do no harm.
    """
    reader = spark.read.option("header", True).option("sep", sep)
    if schema is None:
        df = reader.csv(path)
        return df.select(*columns) if columns else df
    if columns is None:
        return nan_to_null(reader.schema(schema).option("enforceSchema", False).csv(path))
    types = spark.createDataFrame([], schema).schema
    raw = reader.csv(path)
    return nan_to_null(raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in types.fields if f.name in columns]))


def read_wide_days(spark: SparkSession, path: str) -> DataFrame:
    """Wide file with four id columns and one count column per ISO date; the days come from its header line."""
    raw = spark.read.option("header", True).csv(path)
    ids, days = raw.columns[:4], raw.columns[4:]
    return raw.select(
        F.col(f"`{ids[0]}`").cast("int").alias(ids[0]), F.col(f"`{ids[1]}`"), F.col(f"`{ids[2]}`"), F.col(f"`{ids[3]}`").cast("int").alias(ids[3]),
        *[F.col(f"`{d}`").cast("bigint").alias(d) for d in days],
    )


def write_by_date(df: DataFrame, path: str, date: str = "date") -> None:
    """Parquet partitioned by date; only the dates present in ``df`` are replaced.

    Rows of one date are spread by a hash of the row over as many files as the
    date's share of the data calls for, which AQE decides from measured sizes.
    """
    spread = df.hint("rebalance", date)
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
