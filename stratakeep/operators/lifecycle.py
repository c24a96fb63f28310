"""The states of a backup as an automaton over the events of its life.

Being made, a backup holds a lease; when that ends without another event it has failed. An event
that isn't allowed changes nothing and is reported. The same step drives the batch form here and
the stream in `streaming.lifecycle`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakeep.operators.prefix import ranges, running

#: What an event makes of a state: begin and renew give a lease, deleting ends with the backup gone or partly deleted.
NEXT = {
    ("none", "begin"): "creating", ("creating", "renew"): "creating", ("creating", "finish"): "created", ("creating", "fail"): "failed",
    **{(state, "delete"): "deleting" for state in ("creating", "created", "failed", "deleting", "partially_deleted")},
    ("deleting", "remove"): "gone", ("deleting", "keep_shared"): "partially_deleted", ("deleting", "fail"): "failed", ("gone", "begin"): "creating",
}
STATES = ("none", "creating", "created", "failed", "deleting", "partially_deleted", "gone")
RESULT = "backup string, seq long, event string, state string, legal boolean"


def step(state: str, event: str, expired: bool) -> tuple[str, bool]:
    """(state after an event, whether it was allowed); expired: the last lease had ended before it."""
    if expired and state == "creating":
        state = "failed"
    after = NEXT.get((state, event))
    return (state, False) if after is None else (after, True)


def _composed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of sorted rows, what each (backup, range) makes of every state that it may begin in."""
    key, ends, began = None, None, None
    for frame in frames:
        out = []
        for row in frame.itertuples(index=False):
            if (row.backup, row.bucket) != key:
                if key is not None:
                    out.append((*key, ends))
                key, ends = (row.backup, row.bucket), list(STATES)
            ends = [step(s, row.event, row.expired)[0] for s in ends]
        yield pd.DataFrame(out, columns=["backup", "bucket", "ends"])
    if key is not None:
        yield pd.DataFrame([(*key, ends)], columns=["backup", "bucket", "ends"])


def _folded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of sorted rows with the state that each (backup, range) begins in, the state after every event."""
    key, state = None, None
    for frame in frames:
        out = []
        for row in frame.itertuples(index=False):
            if (row.backup, row.bucket) != key:
                key, state = (row.backup, row.bucket), row.start
            state, legal = step(state, row.event, row.expired)
            out.append((row.backup, row.seq, row.event, state, legal))
        yield pd.DataFrame(out, columns=["backup", "seq", "event", "state", "legal"])


def backup_states(events: DataFrame, now: float | None = None) -> DataFrame:
    """(backup, seq, event, state, legal): the state after each event of (backup, seq, event, at, lease).

    seq orders a backup's events, at is their time in seconds, lease is how many seconds from then
    on a backup may be `creating` (null: the lease before it goes on). A lease that ends before an
    event makes a creating backup failed first. With `now`, backups whose lease ends before it get a
    row `expired` behind their last, with that one's seq. Events that aren't known are not allowed,
    like those that don't fit; rows without a backup or seq are left out, and of events of one seq
    the least (at, event) counts.

    An event maps states to states, so a range of events does too: a backup with very many events is
    folded range by range, and only one row a range is put together in sequence.
    """
    known = events.where("backup is not null and seq is not null").groupBy("backup", "seq").agg(F.min(F.struct(F.col("at").cast("double").alias("at"), F.coalesce("event", F.lit("")).alias("event"), F.col("lease").cast("double").alias("lease"))).alias("e"))
    known = known.select("backup", F.col("seq").cast("long").alias("seq"), "e.event", "e.at", (F.col("e.at") + F.col("e.lease")).alias("until"))
    held = F.when(F.col("until").isNotNull(), F.struct("seq", "until"))
    leased = running(known, ["backup"], "seq", [], lease=(F.max, held, False))
    dealt = ranges(leased, "seq", "bucket").select("backup", "bucket", "seq", "event", F.coalesce(F.col("at") > F.col("lease.until"), F.lit(False)).alias("expired"))
    placed = lambda df: df.repartition("backup", "bucket").sortWithinPartitions("backup", "bucket", "seq")
    maps = placed(dealt).mapInPandas(_composed, "backup string, bucket int, ends array<string>")
    # as many elements as there are ranges
    inorder = maps.groupBy("backup").agg(F.array_sort(F.collect_list(F.struct("bucket", "ends"))).alias("maps"))
    index = F.array(*map(F.lit, STATES))
    start = F.struct(F.lit("none").alias("state"), F.array().cast("array<struct<bucket:int,start:string>>").alias("starts"))
    taken = F.aggregate("maps", start, lambda acc, m: F.struct(
        F.get(m["ends"], F.array_position(index, acc["state"]).cast("int") - 1).alias("state"),
        F.concat(acc["starts"], F.array(F.struct(m["bucket"].alias("bucket"), acc["state"].alias("start")))).alias("starts"),
    ))
    starts = inorder.select("backup", F.explode(taken["starts"]).alias("s")).select("backup", "s.bucket", "s.start")
    out = placed(dealt.join(starts, ["backup", "bucket"])).mapInPandas(_folded, RESULT)
    if now is None:
        return out
    last = out.groupBy("backup").agg(F.max(F.struct("seq", "state")).alias("last"))
    lease = known.groupBy("backup").agg(F.max(held)["until"].alias("until"))
    ended = last.join(lease, "backup").where((F.col("last.state") == "creating") & (F.col("until") < F.lit(now)))
    return out.unionByName(ended.select("backup", "last.seq", F.lit("expired").alias("event"), F.lit("failed").alias("state"), F.lit(True).alias("legal")))
