"""Runs that fall silent, found by timers: a stream of changes of reports goes in, the runs to be queued again come out.

State tells of each report when it was last heard of, and its run. A running report that has crawled nothing waits for
the moment at which its silence has lasted STALE_SECONDS; any sign of progress, or the end of the run, ends that. Reports whose
numbers stand next to one another share a key, its value and its timer, which is for the first of those moments: a batch
costs a call for each such bucket that it touches, not for each report, and buckets grow in number, not in size. So nobody
looks through all reports to find the silent ones.

Timers go by the clock (such a stream has no end; give it a trigger by processing time), or, for replays, by event time: then the greatest `seen_at`, less `late`, is the time. Rows without
a uid are signs that the service lives: they move event time on while no report changes. Of several rows of a report the
one seen last counts, and of those seen in the same second one that shows progress. A run is told once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from auditloom.operators import reports as R
from auditloom.schemas import RUNNING, STALE_SECONDS
from auditloom.streaming.frontier import ROCKSDB

#: What is heard of a report; seen_at is a timestamp.
CHANGE = "uid bigint, seen_at timestamp, status int, started_at bigint, pages_crawled bigint, progress_pages bigint, last_crawled_url string"
SILENT = "uid bigint, queued_at bigint"
#: Reports whose numbers are alike but for so many bits share a key.
BUCKET_BITS = 10
#: What is held of a report; wake is what it waits for, in milliseconds.
HEARD = np.dtype([("uid", "<i8"), ("seen", "<i8"), ("started_at", "<i8"), ("wake", "<i8"), ("running", "?"), ("told", "?")])
NEVER = np.iinfo(np.int64).max


class Silence(StatefulProcessor):
    """Of a bucket of up to 2**BUCKET_BITS reports: HEARD rows by uid as one value, and a timer for the next moment that one of them waits for."""

    def __init__(self, by_clock: bool):
        self.by_clock = by_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.heard = handle.getValueState("bucket", "heard binary")

    def now(self, times) -> int:
        """In milliseconds."""
        return times.getCurrentProcessingTimeInMs() if self.by_clock else times.getCurrentWatermarkInMs()

    def held(self) -> np.ndarray:
        return np.frombuffer(self.heard.get()[0], HEARD) if self.heard.exists() else np.zeros(0, HEARD)

    def keep(self, held: np.ndarray) -> None:
        if not len(held):
            self.heard.clear()
            return
        self.heard.update((held.tobytes(),))
        if held["wake"].min() < NEVER:
            self.handle.registerTimer(int(held["wake"].min()))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = pd.DataFrame()
        for frame in rows:  # what is kept of them is a row for each report
            frame = pd.concat([last, frame[frame.known]])
            last = frame.sort_values(["uid", "seen", "idle", "started_at", "running"], ascending=[True, True, False, True, False]).drop_duplicates("uid", keep="last")
        if not len(last):
            return
        held = self.held()
        new = np.zeros(len(last), HEARD)
        for column in ("uid", "seen", "running", "started_at"):
            new[column] = last[column].to_numpy()
        idle = last.idle.to_numpy(dtype=bool)
        at = np.searchsorted(held["uid"], new["uid"])
        known = at < len(held)
        known[known] = held["uid"][at[known]] == new["uid"][known]
        old = np.zeros(len(new), HEARD)
        old[known] = held[at[known]]
        newer = ~known | (new["seen"] >= old["seen"])
        new, old, idle = new[newer], old[newer], idle[newer]
        now, running = self.now(timerValues), new["running"]
        told = running & old["told"] & (new["started_at"] == old["started_at"])
        due = (np.minimum(new["started_at"], NEVER // 2000) + STALE_SECONDS) * 1000 - 1  # a timer fires behind its time
        found = running & ~told & ((new["started_at"] <= 0) | (idle & (due < now)))
        new["told"] = told | found
        # From its end on nothing older comes, and a report can be forgotten.
        new["wake"] = np.where(~running, np.maximum(new["seen"] * 1000, now) + 1, np.where(idle & ~new["told"], due, NEVER))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        held = np.concatenate([held[~np.isin(held["uid"], new["uid"])], new])
        self.keep(held[np.argsort(held["uid"])])
        if found.any():
            yield pd.DataFrame({"uid": new["uid"][found], "queued_at": np.maximum(now // 1000, new["seen"][found])})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, now = self.held().copy(), self.now(timerValues)
        due = held["wake"] < now
        found = due & held["running"]
        held["told"] |= found
        held["wake"][due] = NEVER
        self.keep(held[~due | held["running"]])
        if found.any():
            yield pd.DataFrame({"uid": held["uid"][found], "queued_at": now // 1000})

    def close(self) -> None:
        pass


def silent(changes: DataFrame, late: str | None = None) -> DataFrame:
    """uid, queued_at of each run in a stream of CHANGE rows that falls silent; by the clock, or by event time if `late` is given."""
    changes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    if late is not None:
        changes = changes.withWatermark("seen_at", late)
    started = F.coalesce("started_at", F.lit(0)).cast("bigint")
    uid = F.coalesce(F.col("uid").cast("bigint"), F.lit(0))
    rows = changes.select("seen_at", F.shiftright(uid, BUCKET_BITS).alias("bucket"), uid.alias("uid"), F.col("uid").isNotNull().alias("known"), F.unix_seconds("seen_at").alias("seen"), F.coalesce(F.col("status") == RUNNING, F.lit(False)).alias("running"), started.alias("started_at"), F.coalesce(R.is_idle(), F.lit(True)).alias("idle"))
    rows = rows.where("seen_at IS NOT NULL")
    return rows.groupBy("bucket").transformWithStateInPandas(Silence(late is None), SILENT, "append", "processingTime" if late is None else "eventTime")


def requeued(reports: DataFrame, found: DataFrame) -> DataFrame:
    """reports with the silent runs (uid, queued_at) back in the queue, as far as they still run."""
    rows = reports.join(found.groupBy("uid").agg(F.max("queued_at").alias("_again")), "uid", "left")
    return R.reset_stale(rows, F.col("_again"), (F.col("status") == RUNNING) & F.col("_again").isNotNull()).select(*reports.columns)
