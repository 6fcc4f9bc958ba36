"""Tables as streams: slices of a table arrive one after another, and a query is restarted for each.

Every slice is a run with ``availableNow`` from the same checkpoint, so state is stored and recovered
between slices, as after a restart.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


@dataclass
class Run:
    """What a replay wrote and what Spark counted on the way."""

    out: DataFrame
    late: int = 0
    progress: list[dict] = field(default_factory=list)


def late_rows(query: StreamingQuery) -> int:
    """Rows that the watermark dropped so far."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def replay(spark: SparkSession, slices: Sequence[DataFrame], folder: str, job: Callable[[DataFrame], DataFrame]) -> Run:
    """Append each slice to a folder, run the job on what is new, and read back all it has emitted."""
    run = Run(out=None)
    for rows in slices:
        rows.write.mode("append").parquet(f"{folder}/in")
        out = job(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
        query = out.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
        query = query.trigger(availableNow=True).start()
        query.awaitTermination()
        run.late += late_rows(query)
        run.progress += [json.loads(p.json) for p in query.recentProgress]
    run.out = spark.read.schema(out.schema).parquet(f"{folder}/out")
    return run


def shuffled_slices(rows: DataFrame, ts: str, order: str, slices: int, jitter_s: float) -> list[DataFrame]:
    """Cut a table into slices that arrive in turn; a row arrives up to ``jitter_s`` late, by a hash, so
    that slices overlap in time."""
    ends = rows.agg(F.min(F.unix_micros(ts)).alias("a"), F.max(F.unix_micros(ts)).alias("b")).first()
    if ends["a"] is None:
        return [rows]
    width = max(1, -(-(ends["b"] - ends["a"] + 1) // slices))
    late = F.pmod(F.xxhash64(F.col(order)), F.lit(int(jitter_s * 1_000_000) + 1))
    at = F.least(F.lit(slices - 1), F.floor((F.unix_micros(ts) - F.lit(ends["a"]) + late) / F.lit(width)))
    return [rows.filter(at == i) for i in range(slices)]


def end_marker(rows: DataFrame, ts: str, seconds_after: float, **other) -> DataFrame:
    """One row far behind the last, which moves the watermark past every open deadline. Other columns are null
    but for those named."""
    last = rows.agg(F.max(ts).alias("_last")).filter("_last is not null")
    values = [
        F.timestamp_micros(F.unix_micros("_last") + int(seconds_after * 1_000_000)).alias(f.name) if f.name == ts
        else F.lit(other.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema.fields
    ]
    return last.select(*values)
