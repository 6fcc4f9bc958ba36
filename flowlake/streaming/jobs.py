"""Streams that Spark's own stateful operators express: deduplication, windowed and session counts, the sink.

Each takes a streaming DataFrame with an event-time column. Rows later than the watermark are dropped by
Spark and counted in the progress of the query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowlake.sources.sinks import append_events


def dedup(stream: DataFrame, keys: Sequence[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """First row of each key; a key is remembered as long as the watermark allows."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(stream: DataFrame, key: str, ts: str, size: str, delay: str, slide: str | None = None) -> DataFrame:
    """Events per key and event-time window."""
    win = F.window(ts, size, slide) if slide else F.window(ts, size)
    counted = stream.withWatermark(ts, delay).groupBy(key, win.alias("w")).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def session_counts(stream: DataFrame, key: str, ts: str, gap: str, delay: str) -> DataFrame:
    """Events per key and inactivity session."""
    counted = stream.withWatermark(ts, delay).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("w.start").alias("first_ts"), F.col("w.end").alias("closes_ts"), "n")


def sink_events(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Idempotent event sink: a micro-batch that is replayed stores nothing twice."""
    write = stream.writeStream.foreachBatch(lambda batch, _: append_events(batch, path))
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def as_stream(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    """The rows as files of a folder, read as a stream."""
    rows.write.parquet(f"{folder}/in")
    return spark.readStream.schema(rows.schema).parquet(f"{folder}/in")


def sink_once(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    """Send the rows through ``sink_events`` twice, as after a restart from scratch, and read the table."""
    stream = as_stream(spark, rows, folder)
    for turn in range(2):
        sink_events(stream, f"{folder}/table", f"{folder}/checkpoint-{turn}").awaitTermination()
    return spark.read.parquet(f"{folder}/table")
