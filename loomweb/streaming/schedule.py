"""Jobs that fire when they are due, as keyed state with timers: a job fires, stores when, and sets its next time.

A stream of commands makes, changes, stops and removes jobs; its event time is the clock, which rows of any key move
on.  State and timers are kept in the stream's checkpoint, so a restart goes on where the last batch ended, and a job
that was due several times while nothing ran fires once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

HOUR, DAY = 3_600_000, 86_400_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COMMANDS = "job_id string, at timestamp, action string, kind string, hours int, minute int"
FIRED = "job_id string, due_at timestamp, fired_at timestamp, next_at timestamp"


def next_time(kind: str, hours: int, minute: int, last: int | None, now: int) -> int:
    """When a job is due next (ms).  interval: so many hours after the last run, at once without one; daily: at a minute of the
    day, today's if the job has not run since then, else tomorrow's."""
    if kind == "interval":
        return now if last is None else last + hours * HOUR
    clock = now - now % DAY + minute * 60_000
    return clock if last is None or last < clock else clock + DAY


class JobTimers(StatefulProcessor):
    """For each job: (kind, hours, minute, enabled, last run) and at most one timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "kind string, hours int, minute int, enabled boolean, last long")

    def _set(self, job: tuple, now: int) -> int | None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.job.update(job)
        kind, hours, minute, enabled, last = job
        if not enabled:
            return None
        at = max(now, next_time(kind, hours, minute, last, now))
        self.handle.registerTimer(at)
        return at

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        commands = pd.concat(list(rows)).sort_values("at", kind="stable")
        for c in commands.itertuples():
            now, job = int(c.at.timestamp() * 1000), self.job.get() if self.job.exists() else None
            if c.action == "add":
                self._set((c.kind, int(c.hours), int(c.minute), True, None), now)
            elif job is not None and c.action == "toggle":
                self._set((*job[:3], not job[3], job[4]), now)
            elif job is not None and c.action == "remove":
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.job.clear()
        yield pd.DataFrame({n: pd.Series(dtype=t) for n, t in (("job_id", "object"), *((c, "datetime64[ns]") for c in ("due_at", "fired_at", "next_at")))})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.job.exists():
            return
        now, due = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        kind, hours, minute, enabled, _ = self.job.get()
        after = self._set((kind, hours, minute, enabled, now), now)
        if enabled:
            yield pd.DataFrame({"job_id": [key[0]], **{n: [pd.Timestamp(ms, unit="ms")] for n, ms in (("due_at", due), ("fired_at", now), ("next_at", after))}})

    def close(self) -> None:
        pass


def firings(commands: DataFrame) -> DataFrame:
    """commands: a stream of COMMANDS.  FIRED, a row for each time that a job fires."""
    timed = commands.withWatermark("at", "0 seconds")
    return timed.groupBy("job_id").transformWithStateInPandas(JobTimers(), FIRED, "Append", "EventTime")


def run_due(commands: DataFrame, run: Callable[[DataFrame, int], None], folder: str, **trigger) -> StreamingQuery:
    """Hands each batch's firings to run (with the batch's number, under which it should store what it does, so that a batch
    that is run again overwrites it)."""
    spark = commands.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    writer = firings(commands).writeStream.foreachBatch(lambda rows, n: run(rows.filter(F.col("job_id").isNotNull()), n))
    return writer.option("checkpointLocation", f"{folder}/progress").trigger(**(trigger or {"availableNow": True})).start()
