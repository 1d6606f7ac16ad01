"""Streaming forms of event deduplication and of exposure detection."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues


def distinct_impressions(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each impression_key once, as long as its repeats come within the watermark; events have ts and impression_key."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["impression_key"])


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


class _Exposure(StatefulProcessor):
    """Since when an item is half visible without a break, when its last sample was, and whether it has been told.

    An exposure has a timer at its end: it fires when time has passed, with or without a further sample. A sample that
    says hidden takes the timer away. An item without samples for a while is forgotten by another timer."""

    def __init__(self, least_ms: int, threshold: float, forget_ms: int):
        self.least_ms, self.threshold, self.forget_ms = least_ms, threshold, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("exposure", "since long, last long, told boolean")

    def _tell(self, key: tuple, at: list[int]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"item_id": [key[0]] * len(at), "seen_at": at})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        since, last, told = self.state.get() if self.state.exists() else (-1, -1, False)
        seen, before, idle = [], since, last + self.forget_ms if last >= 0 else -1
        samples = pd.concat(list(rows)).sort_values("at_ms")
        for at, ratio, visible in samples[["at_ms", "ratio", "visible"]].itertuples(index=False):
            if at < last:
                continue  # its time has been decided
            last = at = int(at)
            if since >= 0 and not told and at - since >= self.least_ms:
                seen.append(since + self.least_ms)
                told = True
            shown = bool(visible) and ratio >= self.threshold
            since = (since if since >= 0 else at) if shown else -1
        pending = since + self.least_ms if since >= 0 and not told else -1
        due = before + self.least_ms if before >= 0 else -1
        timers = set(self.handle.listTimers())
        for old, new in ((due, pending), (idle, last + self.forget_ms if last >= 0 else -1)):
            if old != new and old in timers:
                self.handle.deleteTimer(old)
            if new >= 0 and (old != new or new not in timers):
                self.handle.registerTimer(new)
        self.state.update((since, last, told))
        yield from self._tell(key, seen)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen = []
        if self.state.exists():
            since, last, told = self.state.get()
            at = expiredTimerInfo.getExpiryTimeInMs()
            if since >= 0 and not told and at >= since + self.least_ms:
                seen, told = [since + self.least_ms], True
            if at >= last + self.forget_ms:
                self.state.clear()
            else:
                self.state.update((since, last, told))
        yield from self._tell(key, seen)

    def close(self) -> None:
        pass


def seen_items(samples: DataFrame, least_ms: int = 500, late: str = "0 seconds", threshold: float = 0.5, forget_ms: int = 86_400_000) -> DataFrame:
    """(item_id, seen_at): an item once it has been half visible for least_ms without a break, once for each item.

    samples: (item_id, at timestamp, ratio, visible). Time is that of the samples: the exposure comes when the watermark,
    late behind the newest sample of any item, passes its end, or earlier if a later sample of the item comes. Samples that
    are later than that, or older than one already used, are of no account; a null ratio counts as hidden. An item without
    samples for forget_ms is forgotten, with what was told of it. Needs the RocksDB state store."""
    rows = samples.select("item_id", F.col("at").cast("timestamp").alias("at"), F.unix_millis(F.col("at").cast("timestamp")).alias("at_ms"), F.coalesce("ratio", F.lit(0.0)).alias("ratio"), F.coalesce("visible", F.lit(False)).alias("visible"))
    return rows.withWatermark("at", late).groupBy("item_id").transformWithStateInPandas(_Exposure(least_ms, threshold, forget_ms), "item_id long, seen_at long", "Append", "EventTime")
