"""Stage tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelspark.session import scratch_path


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """``df`` as a Parquet table under ``spark.checkpoint.dir``: read again rather than computed again."""
    spark = df.sparkSession
    path = scratch_path(spark, "llm")
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Removes stage tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._stage_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
