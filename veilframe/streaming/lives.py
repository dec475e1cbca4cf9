"""A session's life in event time: touches get their epoch and alias, and expiry is a row of its own.

Events (session, ts, seq, type: touch or clear, original, kind) may come late by the watermark's delay, in any order.
They wait in state until the watermark has passed them, and are then taken in the order of (ts, seq), clearings first
among those of one moment; so what comes out doesn't depend on how they came. A timer wakes a session when the watermark
reaches its next waiting event or its next expiry. An event that comes later than the watermark is dropped by Spark and
counted in the query's progress: its moment is over, and expiries that followed from it have been told.

Out come, for each touch, its ts and seq with epoch and token as operators.session has them; for each entry whose idle
time ends, a row of type expired at that moment; for each cleared one, a row of type cleared. State: events within the
delay, living entries, and numbers, which live on: of kinds, and of epochs by original.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.patterns import IDLE_SECONDS

OUT = "session string, ts timestamp, seq long, type string, original string, token string, epoch long"
NAMES = ["session", "ts", "seq", "type", "original", "token", "epoch"]


class Lives(StatefulProcessor):
    """State of one session; moments are microseconds."""

    def __init__(self, idle_seconds: int = IDLE_SECONDS):
        self.idle = idle_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, seq long, type string, original string, kind string")
        self.entries = handle.getMapState("entries", "original string", "token string, epoch long, last long")
        self.counters = handle.getMapState("counters", "kind string", "n long")
        self.epochs = handle.getMapState("epochs", "original string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        moments = set()
        for part in rows:
            events = [(int(t), int(seq), type_, original, kind) for t, seq, type_, original, kind in zip(part["t"], part["seq"], part["type"], part["original"], part["kind"], strict=True)]
            self.waiting.appendList(events)
            moments |= {e[0] // 1000 + 1 for e in events}
        for ms in moments:
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((e for e in waiting if e[0] < now), key=lambda e: (e[0], e[2] != "clear", e[1]))
        was = {k[0]: tuple(v) for k, v in self.entries.iterator()}
        live, out = {o: list(e) for o, e in was.items()}, []

        def row(t: int, seq: int | None, type_: str, original: str) -> None:
            moment = datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=t)
            out.append((key[0], moment, seq, type_, original, live[original][0], live[original][1]))

        def expire(t: int) -> None:
            for original in sorted((o for o, e in live.items() if e[2] + self.idle <= t), key=lambda o: (live[o][2], o)):
                row(live[original][2] + self.idle, None, "expired", original)
                del live[original]

        for t, seq, type_, original, kind in ready:
            expire(t)
            if type_ == "clear":
                for o in list(live):
                    row(t, seq, "cleared", o)
                live.clear()
                continue
            if original not in live:
                n, epoch = (s.getValue((k,))[0] + 1 if s.containsKey((k,)) else 1 for s, k in ((self.counters, kind), (self.epochs, original)))
                self.counters.updateValue((kind,), (n,))
                self.epochs.updateValue((original,), (epoch,))
                live[original] = [f"{kind.upper()}_{n}", epoch, t]
            live[original][2] = t
            row(t, seq, "touch", original)
        expire(now)
        if ready:
            rest = [e for e in waiting if e[0] >= now]
            self.waiting.put(rest) if rest else self.waiting.clear()
        for o in was:
            if o not in live:
                self.entries.removeKey((o,))
        for o, e in live.items():
            if was.get(o) != tuple(e):
                self.entries.updateValue((o,), tuple(e))
        if live:
            self.handle.registerTimer((min(e[2] for e in live.values()) + self.idle) // 1000 + 1)
        return iter([pd.DataFrame(out, columns=NAMES)] if out else [])

    def close(self) -> None:
        pass


def lives_stream(events: DataFrame, delay: str = "10 minutes", idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """A stream of events with their lives, and the ends of these; needs the RocksDB state store."""
    ts = F.col("ts").cast("timestamp")
    e = events.select("session", ts.alias("ts"), F.unix_micros(ts).alias("t"), F.col("seq").cast("long").alias("seq"), "type", "original", "kind").withWatermark("ts", delay)
    return e.groupBy("session").transformWithStateInPandas(Lives(idle_seconds), outputStructType=OUT, outputMode="append", timeMode="eventTime")
