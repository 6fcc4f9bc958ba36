"""Counts that a stream takes of itself on the way, without a second pass.

``observed`` attaches named aggregates to a stream; Spark computes them inside the tasks of each micro-batch.
``MeasureLog`` is a listener that keeps, per micro-batch, those aggregates with the rows read, the
watermark, the rows the watermark dropped and the rows held in state; ``as_table`` turns it into a table.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "query string, batch_id long, measure string, value double"


def observed(stream: DataFrame, name: str, **aggregates: Column) -> DataFrame:
    return stream.observe(name, *[c.alias(n) for n, c in aggregates.items()])


def count_by(column: str, values: Sequence[str]) -> dict[str, Column]:
    """A count per value, for ``observed``."""
    return {v: F.count_if(F.col(column) == v) for v in values}


class MeasureLog(StreamingQueryListener):
    """Progress of all queries of a session, or of the one named."""

    def __init__(self, query: str | None = None):
        self.query, self.rows = query, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.add(json.loads(event.progress.json))

    def add(self, p: dict) -> None:
        name = p.get("name") or p["id"]
        if self.query is not None and name != self.query:
            return
        state = p.get("stateOperators") or []
        self.put(name, p, "input_rows", p.get("numInputRows", 0))
        self.put(name, p, "late_rows", sum(s["numRowsDroppedByWatermark"] for s in state))
        self.put(name, p, "state_rows", sum(s["numRowsTotal"] for s in state))
        for group, metrics in (p.get("observedMetrics") or {}).items():
            for measure, value in metrics.items():
                if value is not None:
                    self.put(name, p, f"{group}.{measure}", value)

    def put(self, name: str, p: dict, measure: str, value) -> None:
        self.rows.append((name, p["batchId"], measure, float(value)))


def as_table(spark: SparkSession, log: MeasureLog) -> DataFrame:
    """query, batch_id, measure, value: a few numbers per micro-batch."""
    return spark.createDataFrame(list(log.rows), SCHEMA)


def totals(table: DataFrame, last: Sequence[str] = ("state_rows",)) -> DataFrame:
    """Sums over the batches of a query; the largest value of those in ``last``."""
    return table.groupBy("query", "measure").agg(F.max("value").alias("_max"), F.sum("value").alias("_sum")).select(
        "query", "measure", F.when(F.col("measure").isin(*last), F.col("_max")).otherwise(F.col("_sum")).alias("value"))
