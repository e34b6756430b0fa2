"""Streaming ingest and tails with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from oxbow.sources.records import json_lines


def dropped_files(spark: SparkSession, folder: str, schema: dict[str, str]) -> DataFrame:
    """A stream of the records in *.ndjson files that arrive in `folder`; each file is read once."""
    return json_lines(spark.readStream.option("pathGlobFilter", "*.ndjson").text(folder), schema)


def kafka_records(spark: SparkSession, servers: str, topic: str, schema: dict[str, str]) -> DataFrame:
    source = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return json_lines(source.select(F.col("value").cast("string").alias("value")), schema)


def append_once(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append to Parquet; the file sink's log makes retried batches idempotent."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def windowed_counts(stream: DataFrame, time_col: str, size: str, late: str, *keys: str) -> DataFrame:
    """Counts per tumbling window and keys; rows later than `late` are dropped, so state stays bounded."""
    return spans(stream, time_col, F.window(time_col, size), late, *keys)


def sliding_counts(stream: DataFrame, time_col: str, size: str, slide: str, late: str, *keys: str) -> DataFrame:
    """Counts per window of `size` that begins every `slide`."""
    return spans(stream, time_col, F.window(time_col, size, slide), late, *keys)


def session_counts(stream: DataFrame, time_col: str, gap: str, late: str, *keys: str) -> DataFrame:
    """Counts per session: rows of the keys that follow each other within `gap`."""
    return spans(stream, time_col, F.session_window(time_col, gap).alias("window"), late, *keys)


def spans(stream: DataFrame, time_col: str, window: Column, late: str, *keys: str) -> DataFrame:
    return stream.withWatermark(time_col, late).groupBy(window, *keys).count().select(F.col("window.start").alias("start"), *keys, "count")
