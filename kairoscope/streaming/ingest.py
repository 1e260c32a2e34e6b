"""Incremental ingest and event-time windows with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 4) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest_once(source: DataFrame, target: str, checkpoint: str, key: list[str]) -> None:
    """All new rows, in batches, each appended if its key is new. A batch that is
    run again after a failure gives the same rows: it is held against the batches
    before it alone, and its path is named by its number. A target belongs to one
    checkpoint."""

    def write(batch: DataFrame, number: int) -> None:
        write_batch(batch, number, target, key)

    source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def write_batch(batch: DataFrame, number: int, target: str, key: list[str]) -> None:
    batch = batch.dropDuplicates(key)
    if number > 0:
        # batches are numbered from 0 on, and each leaves a folder
        old = batch.sparkSession.read.schema(batch.select(*key).schema.add("batch", "long")).parquet(target)
        batch = batch.join(old.where(F.col("batch") < number).select(*key), key, "left_anti").select(batch.columns)
    batch.write.mode("overwrite").parquet(f"{target}/batch={number}")


def tumbling(events: DataFrame, *, width: str, late: str = "10 minutes", on="ts", by: str = "event_type", value="value") -> DataFrame:
    """Counts and sums by window and key; rows later than ``late`` drop out of a stream."""
    return (
        events.withWatermark(on, late).groupBy(F.window(on, width), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        .select(F.col("window.start").alias("start"), by, "n", "total")
    )


def sliding(events: DataFrame, *, width: str, step: str, late: str = "10 minutes", on="ts", by: str = "event_type", value="value") -> DataFrame:
    return (
        events.withWatermark(on, late).groupBy(F.window(on, width, step), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        .select(F.col("window.start").alias("start"), by, "n", "total")
    )


def sessions(events: DataFrame, *, gap: str, late: str = "10 minutes", on="ts", by: str = "user_id") -> DataFrame:
    return (
        events.withWatermark(on, late).groupBy(F.session_window(on, gap), by).agg(F.count(F.lit(1)).alias("n"))
        .select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
    )
