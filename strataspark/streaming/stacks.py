"""Stacks that grow with a stream: windowed sums with a watermark, and merges into a table by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Event files of a folder as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def window_stack(events: DataFrame, length: str = "1 day", late: str = "1 day") -> DataFrame:
    """Sum and number of values by station, channel and window; additive, so windows add up to longer stacks.

    Works on streams and tables alike; on a stream, windows are final once the watermark passes their end.
    """
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", length), "user_id", "event_type").agg(F.sum("value").alias("total"), F.count("*").alias("n")).select("user_id", "event_type", F.col("window.start").alias("start"), "total", "n")


def merge_into(path: str):
    """A foreachBatch function that keeps stacks (user_id, event_type, total, n) in versioned folders of path.

    A batch writes version batch_id from the one before it, so a batch that runs again overwrites what it wrote.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("user_id", "event_type").agg(F.sum("value").alias("total"), F.count("*").alias("n"))
        if batch_id:
            new = spark.read.parquet(f"{path}/v{batch_id - 1}").unionByName(new).groupBy("user_id", "event_type").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        new.write.mode("overwrite").parquet(f"{path}/v{batch_id}")

    return merge
