"""Incremental ingest of daily post files."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from panelspark.operators.events import flatten_posts
from panelspark.sources import schemas


def ingest_new_files(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 1000) -> None:
    """Flattens the files not seen before into Parquet partitioned by date, then stops.

    The checkpoint remembers finished files and the sink commits whole batches,
    so a restart after a failure neither skips nor repeats one. The transform
    is the one the batch path uses.
    """
    raw = (
        spark.readStream.schema(schemas.POSTS)
        .option("mode", "FAILFAST")
        .option("maxFilesPerTrigger", files_per_batch)
        .json(source)
    )
    events = flatten_posts(raw).withColumn("date", F.to_date("event_time"))
    query = (
        events.writeStream.format("parquet")
        .partitionBy("date")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
