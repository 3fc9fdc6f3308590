"""Structured Streaming: incremental chunk index, and event-time windows (beyond the reference's own operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examloom.operators.chunking import chunk
from examloom.operators.indexing import overwrite_sources, with_keys


def index_stream(spark: SparkSession, folder: str, schema: str, index: str, checkpoint: str, method: str = "fast", source: str = "source", text: str = "text") -> None:
    """Index what is new in a folder of Parquet files and stop; files already seen are skipped by the checkpoint."""

    def step(batch: DataFrame, _id: int) -> None:
        made = chunk(batch, method, key=source, text=text)
        overwrite_sources(with_keys(made.withColumnRenamed(source, "source"), method), index)

    stream = spark.readStream.schema(schema).parquet(folder)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def tumbling(events: DataFrame, size: str, late: str | None = None) -> DataFrame:
    """Counts and sums by type and fixed windows; late bounds the state of a stream."""
    df = events.withWatermark("ts", late) if late else events
    return df.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str, slide: str) -> DataFrame:
    return events.groupBy(F.window("ts", size, slide).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Each user's runs of events with gaps below the given one."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


def first_seen(events: DataFrame, late: str) -> DataFrame:
    """Each event id once, within the watermark on a stream."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
