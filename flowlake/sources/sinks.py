"""Idempotent event sinks, JSONL audit log, CSV export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.operators.ordered import first_per_key
from flowlake.schemas import EVENTS, JSON_TYPES


def has_rows(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_events(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Append events whose id is not stored yet, on whatever day it is resent; of an id that the batch
    holds more than once the earliest row is stored.

    The table is partitioned by day. Only the id column of the stored rows is read; the number of write
    tasks follows from the rows of the batch."""
    spark = df.sparkSession
    batch = first_per_key(df.withColumn("event_date", F.to_date("ts")), ["event_id"], ["ts"])
    if has_rows(spark, path):
        batch = batch.join(spark.read.parquet(path).select("event_id"), "event_id", "left_anti")
    batch.hint("rebalance", "event_date").sortWithinPartitions("event_date", "source_ip").write.mode("append").option(
        "maxRecordsPerFile", rows_per_file
    ).partitionBy("event_date").parquet(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_jsonl(spark: SparkSession, path: str, schema=EVENTS) -> DataFrame:
    """Replay of the audit log; malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def to_json_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.to_json(c) for c in JSON_TYPES})


def from_json_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.from_json(c, t) for c, t in JSON_TYPES.items()})


def export_columns(digits: dict[str, int], order: Sequence[str]) -> list[Column]:
    return [F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in order]


def export_csv(df: DataFrame, path: str, order: Sequence[str], digits: dict[str, int]) -> None:
    """Fixed column order and rounding; one file per partition."""
    df.select(*export_columns(digits, order)).write.mode("overwrite").option("header", True).csv(path)
