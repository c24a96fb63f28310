"""Backup states as a stream: events in any order, leases that end on a timer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stratakeep.operators.lifecycle import RESULT, step

_COLUMNS = ["backup", "seq", "event", "state", "legal"]


class Lifecycle(StatefulProcessor):
    """Applies a backup's events in the order of seq, which counts from 0; those that come early wait for what is missing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", "state string, next long, until double")
        self.waiting = handle.getMapState("waiting", "seq long", "event string, at double, until double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, following, until = self.current.get() if self.current.exists() else ("none", 0, None)
        held = until
        early: dict[int, tuple] = {}
        for frame in rows:
            for row in frame.itertuples(index=False):
                if row.seq >= following:  # what has been applied comes again after a restart
                    event = (row.event, float(row.at), None if pd.isna(row.lease) else float(row.at + row.lease))
                    old = early.get(row.seq) or (self.waiting.getValue((row.seq,)) if self.waiting.containsKey((row.seq,)) else None)
                    early[row.seq] = min(event, tuple(old), key=lambda e: (e[1], e[0])) if old is not None else event
        out = []
        while True:
            if following in early:
                event, at, lease = early.pop(following)
                if self.waiting.containsKey((following,)):
                    self.waiting.removeKey((following,))
            elif self.waiting.containsKey((following,)):
                event, at, lease = self.waiting.getValue((following,))
                self.waiting.removeKey((following,))
            else:
                break
            state, legal = step(state, event, until is not None and at > until)
            until = lease if lease is not None else until
            out.append((key[0], following, event, state, legal))
            following += 1
        for seq, event in early.items():
            self.waiting.updateValue((seq,), event)
        self.current.update((state, following, until))
        if until is not None and until != held and state == "creating":
            self.handle.registerTimer(int(until * 1000) + 1)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, following, until = self.current.get() if self.current.exists() else ("none", 0, None)
        out = []
        # a lease that was renewed since has a timer of its own
        if state == "creating" and until is not None and expiredTimerInfo.getExpiryTimeInMs() > until * 1000:
            out.append((key[0], following - 1, "expired", "failed", True))
            self.current.update(("failed", following, until))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def stream_states(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(backup, seq, event, state, legal) of streamed events (backup, seq, event, at, lease), as operators.lifecycle.backup_states has them; mode append.

    Events of a backup may come in any order, also in different micro-batches: seq counts from 0,
    and an event waits until all before it are there. One that comes twice counts once. A creating
    backup fails, with a row `expired`, when the stream's time (that of the latest event, less
    `late`) has passed its lease; an event from before then, later than that, finds it failed.
    The stream needs the state store that keeps timers (RocksDB).
    """
    timed = events.withColumn("time", F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))).withWatermark("time", late)
    rows = timed.where("backup is not null and seq is not null").select("backup", F.col("seq").cast("long").alias("seq"), F.coalesce("event", F.lit("")).alias("event"), F.col("at").cast("double").alias("at"), F.col("lease").cast("double").alias("lease"), "time")
    return rows.groupBy("backup").transformWithStateInPandas(statefulProcessor=Lifecycle(), outputStructType=RESULT, outputMode="Append", timeMode="EventTime")
