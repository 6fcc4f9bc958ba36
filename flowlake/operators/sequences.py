"""Sliding sequences of flow rows for sequence models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.operators.ordered import (
    DAY, blocks_with_context, gap_sessions, numbered, time_chunk,
)

BLOCK_ROWS = 50_000


def sequence_windows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, features: Sequence[str], *,
    y: str = "y", length: int = 5, stride: int = 1, label_rule: str = "last", block_rows: int = BLOCK_ROWS,
    split: str | None = None,
) -> DataFrame:
    """Last ``length`` rows of each key at every ``stride``-th row; a window never leaves its key.

    Rows are numbered exactly, cut into blocks with ``length - 1`` rows of context, and the arrays (at
    most ``length`` long) are built inside a block. Window starts follow the stride from the first row
    of the key."""
    ranked = numbered(df, keys, order, chunk)
    placed = blocks_with_context(ranked, "rn", max(length - 1, 1), max(block_rows, length))
    w = Window.partitionBy(*keys, "_block").orderBy("rn").rowsBetween(-(length - 1), 0)
    label = {
        "last": F.col(y).cast("int"),
        "any": F.max(y).over(w).cast("int"),
        "majority": F.bround(F.avg(F.col(y).cast("double")).over(w)).cast("int"),
    }[label_rule]
    cols = {"label": label, "sequence": F.collect_list(F.struct(*features)).over(w)}
    if split is not None:
        cols |= {"split_lo": F.min(split).over(w), "split_hi": F.max(split).over(w)}
    got = placed.withColumns(cols).filter("_own").filter(F.col("rn") >= length)
    got = got.filter(F.pmod(F.col("rn") - length, F.lit(stride)) == 0)
    return got.select(*keys, "rn", *order, "label", "sequence", *(["split_lo", "split_hi"] if split else []))


def host_sessions(df: DataFrame, host: str, ts: str, order: str, gap_s: float = 300.0, reset: str | None = None, chunk_s: float = DAY) -> DataFrame:
    """Session number per host: a gap above ``gap_s`` or a row carrying ``reset`` restarts the buffer."""
    return gap_sessions(df, [host], ts, [order], gap_s, break_before=reset, chunk_s=chunk_s)


def host_session_sequences(df: DataFrame, host: str, ts: str, order: str, features: Sequence[str], *, gap_s: float = 300.0, reset: str | None = None, chunk_s: float = DAY, **kw) -> DataFrame:
    sessions = host_sessions(df, host, ts, order, gap_s, reset, chunk_s)
    return sequence_windows(sessions, [host, "session_seq"], [ts, order], time_chunk(ts, chunk_s), features, **kw)


def sequence_status(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, length: int = 5) -> DataFrame:
    """WARM_UP for the first rows of a segment, ALIGNED after."""
    ranked = numbered(df, keys, order, chunk)
    return ranked.withColumn("seq_status", F.when(F.col("rn") < length, "WARM_UP").otherwise("ALIGNED")).drop("rn")


def status_counts(status: DataFrame, keys: Sequence[str]) -> DataFrame:
    return status.groupBy(*keys).agg(
        F.count_if(F.col("seq_status") == "WARM_UP").alias("warm_up"),
        F.count_if(F.col("seq_status") == "ALIGNED").alias("aligned"),
    )
