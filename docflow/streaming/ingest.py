"""Extensions for streams: a watched folder of files, and job events with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sniff import sniff


def watch_files(spark: SparkSession, path: str, most_per_trigger: int = 1000) -> DataFrame:
    """A stream of (doc_id, filename, bytes, kind, content), a row per new file."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", most_per_trigger).load(path)
    name = F.substring_index("path", "/", -1)
    return files.select(F.col("path").alias("doc_id"), name.alias("filename"), F.col("length").alias("bytes"), sniff(F.col("content"), name)["kind"].alias("kind"), "content")


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events (ts, event_type, value) counted and summed per tumbling window and type; rows later than ``late`` are dropped by the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what is there, and returns its complete result as a table."""
    query = stream.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
