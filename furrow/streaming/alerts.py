"""Alerts for counties that fall silent, out of keyed state with event-time timers."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

DAY = 86_400_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "fips string, event string, last_seen date, day date"


def _date(ms: int) -> dt.date:
    return dt.date(1970, 1, 1) + dt.timedelta(milliseconds=ms)


class SilenceWatch(StatefulProcessor):
    """State of one county: its newest closed day, whether its silence was told, and the days not closed yet.

    A day is closed once the watermark has reached it, so arrivals out of order within the watermark's delay give the
    same alerts. The days not closed are at most those of the delay and of one batch. Of these, the earliest alone has
    a timer: once it fires, all days up to the watermark are closed at once.
    """

    def __init__(self, limit_days: int):
        self.limit = limit_days * DAY

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long, silent boolean")
        self.pending = handle.getListState("pending", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {r[0] for r in self.pending.get()} if self.pending.exists() else set()
        days = {int(t.timestamp() * 1000) for part in rows for t in part["day"].unique()} - known
        if days:
            if not known or min(days) < min(known):
                self.handle.registerTimer(min(days))
            self.pending.put([(d,) for d in sorted(known | days)])
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        days = [r[0] for r in self.pending.get()] if self.pending.exists() else []
        last, silent = self.last.get() if self.last.exists() else (None, False)
        out, before = [], last
        for day in [d for d in days if d <= now]:
            if last is not None and day - last > self.limit:
                if not silent:
                    out.append(("silent", last, last + self.limit + DAY))
                out.append(("back", last, day))
            last, silent = max(day, last or day), False
        if last is not None and not silent and now - last > self.limit:
            out.append(("silent", last, last + self.limit + DAY))
            silent = True
        if last is not None:
            self.last.update((last, silent))
            if last != before and not silent:
                self.handle.registerTimer(last + self.limit + DAY)
            if last != before and before is not None and before + self.limit + DAY > now:
                self.handle.deleteTimer(before + self.limit + DAY)
        left = [(d,) for d in days if d > now]
        if left:
            self.handle.registerTimer(left[0][0])
        if len(left) < len(days):
            self.pending.put(left) if left else self.pending.clear()
        if out:
            yield pd.DataFrame([(key[0], event, _date(a), _date(b)) for event, a, b in out],
                               columns=["fips", "event", "last_seen", "day"])


def silence_alerts(stream: DataFrame, limit_days: int = 7, delay: str = "1 day", event_time: str = "ts") -> DataFrame:
    """Streaming rows (fips, event, last_seen, day): ``silent`` when a county has had no row for more than ``limit_days``.

    ``day`` is the first day over the limit, or the day of the row that ends the silence in a row ``back``. Time is
    the watermark: the newest day of all counties less ``delay``; rows older than that are not looked at. Rows are cut
    to one per county and day by keyed state of its own first, so a county with most of the rows spreads over tasks.
    """
    days = stream.select("fips", F.date_trunc("day", event_time).alias("day")).filter("fips IS NOT NULL")
    once = days.withWatermark("day", delay).dropDuplicatesWithinWatermark(["fips", "day"])
    return once.groupBy("fips").transformWithStateInPandas(
        statefulProcessor=SilenceWatch(limit_days), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


def stream_alerts(stream: DataFrame, target: str, checkpoint: str, limit_days: int = 7, delay: str = "1 day") -> StreamingQuery:
    """Write :func:`silence_alerts` of what is available; every alert is written once, also over restarts."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, ROCKSDB)  # timers need it; the query keeps the setting it was started with
    try:
        return (silence_alerts(stream, limit_days, delay).writeStream.format("parquet").option("path", target)
                .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
    finally:
        conf.set(name, before)
