"""Streaming forms of the stateful scans: stall counts, metadata flushes, restore progress."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _count_stalls(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    pointer, stalls = state.get if state.exists else (None, 0)
    out = []
    for row in pd.concat(list(frames)).sort_values(["ts", "pointer"], kind="stable").itertuples(index=False):
        stalls = stalls + 1 if pointer is None or row.pointer == pointer else 0
        pointer = int(row.pointer)
        out.append((key[0], row.ts, pointer, stalls))
    state.update((pointer, stalls))
    yield pd.DataFrame(out, columns=["database", "ts", "pointer", "stall_count"])


def stall_counts(polls: DataFrame) -> DataFrame:
    """(database, ts, pointer, stall_count) of streamed polls (database string, ts, pointer long).

    A series' first poll counts as one. Within a micro-batch polls are taken by time; a poll that
    comes in a later batch is taken as later.
    """
    return polls.groupBy("database").applyInPandasWithState(
        _count_stalls, "database string, ts timestamp, pointer long, stall_count long", "pointer long, stalls long", "append", GroupStateTimeout.NoTimeout
    )


def _flush(interval: float):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, parts = state.get if state.exists else (None, 0)
        out = []
        for row in pd.concat(list(frames)).sort_values("seconds", kind="stable").itertuples(index=False):
            parts += 1
            if last is None:
                last = float(row.started)
            if row.seconds - last >= interval:
                last = float(row.seconds)
                out.append((key[0], last, parts))
        state.update((last, parts))
        yield pd.DataFrame(out, columns=["backup", "seconds", "parts"])

    return run


def metadata_flushes(uploads: DataFrame, interval: float) -> DataFrame:
    """(backup, seconds, parts): when metadata is written during uploads (backup, started, seconds: double).

    A part's upload writes metadata if the last writing, or the start, is `interval` or more ago;
    parts is how many parts it then lists.
    """
    return uploads.groupBy("backup").applyInPandasWithState(_flush(interval), "backup string, seconds double, parts long", "last double, parts long", "append", GroupStateTimeout.NoTimeout)


#: States of a part in a restore; of two updates of one time the later one here counts.
PROGRESS = ("not_downloaded", "invalid", "downloaded", "restored")


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    latest = [(state.get[0], PROGRESS.index(state.get[1]))] if state.exists else []
    latest += [(float(at), PROGRESS.index(s)) for f in frames for at, s in zip(f["seconds"], f["state"])]
    at, number = max(latest)
    state.update((at, PROGRESS[number]))
    yield pd.DataFrame([(*key, at, PROGRESS[number])], columns=["database", "table", "part", "seconds", "state"])


def restore_progress(updates: DataFrame) -> DataFrame:
    """(database, table, part, seconds, state): the last state of each part so far, by time; mode update.

    updates: (database, table, part, seconds: double, state). A part that was downloaded and then
    found invalid is invalid, so that it is fetched again; an update that comes late changes nothing.
    """
    return updates.groupBy("database", "table", "part").applyInPandasWithState(
        _advance, "database string, table string, part string, seconds double, state string", "seconds double, state string", "update", GroupStateTimeout.NoTimeout
    )
