"""Bursts of events by key, told when they are over: keyed state with a timer for each burst that is still open."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Bursts(StatefulProcessor):
    """Rows of a key belong to one burst if none is more than gap_ms after the one before. A burst is given out when its
    timer runs off, gap_ms after its last row, and forgotten.

    By event time a burst may be made longer, or two made one, by rows that come out of order; late rows do not get here.
    By processing time all rows of a batch are of the batch's time, and there is one burst at most.
    """

    def __init__(self, gap_ms: int, event_time: bool):
        self.gap_ms, self.event_time = gap_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first long, last long, n long")

    def _bursts(self) -> list[tuple[int, int, int]]:
        return [(r[0], r[1], r[2]) for r in self.open.get()] if self.open.exists() else []

    def _keep(self, bursts: list[tuple[int, int, int]]) -> None:
        if bursts:
            self.open.put(bursts)
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = self._bursts()
        counted: dict[int, int] = {}
        for frame in rows:
            times = frame["ms"] if self.event_time else pd.Series(timerValues.getCurrentProcessingTimeInMs(), frame.index)
            for ms, n in times.value_counts().items():
                counted[int(ms)] = counted.get(int(ms), 0) + int(n)
        merged: list[list[int]] = []
        for first, last, n in sorted(old + [(ms, ms, n) for ms, n in counted.items()]):
            if merged and first - merged[-1][1] <= self.gap_ms:
                merged[-1][1], merged[-1][2] = max(merged[-1][1], last), merged[-1][2] + n
            else:
                merged.append([first, last, n])
        before, now = {b[1] for b in old}, {b[1] for b in merged}
        for last in before - now:
            self.handle.deleteTimer(last + self.gap_ms)
        for last in now - before:
            self.handle.registerTimer(last + self.gap_ms)
        self._keep([tuple(b) for b in merged])
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs() - self.gap_ms
        bursts = self._bursts()
        over = [b for b in bursts if b[1] == due]
        self._keep([b for b in bursts if b[1] != due])
        if over:
            yield pd.DataFrame({"key": [key[0]], "first_ms": [over[0][0]], "last_ms": [over[0][1]], "n_events": [over[0][2]]})

    def close(self) -> None:
        pass


def bursts(spark: SparkSession, events: DataFrame, key: str, gap_ms: int, ts: str | None = None, lateness: str = "0 seconds") -> DataFrame:
    """key, first_ms, last_ms, n_events of a stream of events, each burst once, when it is over.

    ts: a timestamp column; a burst is then over when the watermark, lateness behind the latest event, is the gap after it.
    Without it bursts go by the time at which rows come in. State is kept by RocksDB, which this sets for the session.
    """
    spark.conf.set(*STORE)
    rows = events.select(F.col(key).cast("string").alias("key"), *([F.col(ts).alias("ts"), F.unix_millis(ts).alias("ms")] if ts else []))
    if ts:
        rows = rows.withWatermark("ts", lateness)
    out = "key string, first_ms long, last_ms long, n_events long"
    return rows.groupBy("key").transformWithStateInPandas(Bursts(gap_ms, bool(ts)), out, "Append", "EventTime" if ts else "ProcessingTime")
