"""The scalar event log as a stream: windows with a watermark, and an append-only log of new iterations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: count and sum per window and type, late rows dropped after the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def append_log(events: DataFrame, path: str, checkpoint: str):
    """Writes each row once; what was written before a restart is known from the checkpoint."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def newer_than(events: DataFrame, key: str, order: str, written: DataFrame) -> DataFrame:
    """Events after the last written one of their key (written: key, last); a key that was never written gives all."""
    return events.join(written.select(key, "last"), key, "left").where(F.col("last").isNull() | (F.col(order) > F.col("last"))).drop("last")
