"""Keyed state machines over streams whose rows arrive out of order.

A processor of this kind keeps the rows of a key that are still ahead of the watermark in a list state,
and an event-time timer on the earliest of them. When the watermark has passed it, nothing older can
arrive any more (Spark drops and counts such rows), so the ready rows are walked in event order. The
result is therefore that of the same walk over the whole table, however the rows were shuffled over
micro-batches. A second kind of timer lets a processor act without a row: close what has been silent,
or forget it.

State ends: pending rows leave when they are walked, and a processor's own state is cleared by its
deadline. Times are microseconds since 1970; timers have Spark's milliseconds and are rounded up, so a
timer never fires early.
"""

from __future__ import annotations

from abc import abstractmethod
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
US = "event_us"


def _millis(us: int) -> int:
    return -(-us // 1000)


def plain(column: pd.Series) -> list:
    """Values as state variables take them: arrays as lists."""
    return [v.tolist() if isinstance(v, np.ndarray) else v for v in column.tolist()]


class InOrder(StatefulProcessor):
    """``fields`` are the columns of a row, the first two being its time (``event_us``) and a number that
    breaks ties; ``result`` is the schema of what is emitted. Whole numbers must not be null: pandas would
    turn the column into doubles."""

    def __init__(self, fields: str, result: str):
        self.fields, self.result = T.StructType.fromDDL(fields), T.StructType.fromDDL(result)
        self.names, self.out_names = self.fields.fieldNames(), self.result.fieldNames()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.fields)
        self.open(handle)

    @abstractmethod
    def open(self, handle: StatefulProcessorHandle) -> None:
        """Declare further state."""

    @abstractmethod
    def walk(self, key: tuple, rows: Sequence[tuple], now: int) -> tuple[list[tuple], int | None]:
        """Take the rows, in order, and the time ``now`` up to which all rows are known. Returns what is
        emitted and the time of the next deadline, if any."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            if len(pdf):
                self.pending.appendList(list(zip(*(plain(pdf[c]) for c in self.names), strict=True)))
                least = int(pdf[US].min())
                first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(_millis(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.pending.get(), key=lambda r: r[:2]) if self.pending.exists() else []
        ready = sum(r[0] <= now for r in rows)
        found, deadline = self.walk(key, rows[:ready], now)
        if ready:
            if ready < len(rows):
                self.pending.put(rows[ready:])
            else:
                self.pending.clear()
        for at in ([rows[ready][0]] if ready < len(rows) else []) + ([deadline] if deadline is not None else []):
            self.handle.registerTimer(_millis(at))
        return iter([pd.DataFrame.from_records(found, columns=self.out_names)] if found else [])

    def close(self) -> None:
        pass


def walked(stream: DataFrame, keys: Sequence[str], ts: str, delay: str, processor: InOrder) -> DataFrame:
    """Run the processor on every key of the stream; rows later than ``delay`` are dropped and counted."""
    stream.sparkSession.conf.set(PROVIDER, ROCKS)
    grouped = stream.withWatermark(ts, delay).groupBy(*keys)
    return grouped.transformWithStateInPandas(processor, processor.result, "append", "eventTime")
