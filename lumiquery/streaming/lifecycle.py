"""States of jobs that expire: a stateful operator with typed state and event-time timers.

Each job has one value state (its last update, and how many there were) and one list
state (the places that it went through). A job that runs longer than a limit fails by a
timer of event time. A finished job's state stays for a while, so that a repeated or late
update changes nothing, and then leaves by a timer too; so the state's size follows the
jobs that are open or just finished, never the history.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .jobs import STATES

#: States that end a job.
FINAL = ("completed", "failed")
EXPIRED = "TIMED_OUT"
OUTPUT = "id string, status string, updated_at timestamp, n_updates long, path array<string>, error_code string"
RUN_LIMIT, KEEP = timedelta(hours=24), timedelta(hours=1)
#: The store that typed state and timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _time(micros: int) -> datetime:
    return EPOCH + timedelta(microseconds=micros)


class JobLifecycle(StatefulProcessor):
    """One job: forward through its states, out of them by time."""

    def __init__(self, run_limit: timedelta = RUN_LIMIT, keep: timedelta = KEEP) -> None:
        self.run_ms, self.keep_ms = (int(t.total_seconds() * 1000) for t in (run_limit, keep))

    def init(self, handle: StatefulProcessorHandle) -> None:
        """State variables of the operator."""
        self.handle = handle
        self.last = handle.getValueState("last", "at long, place int, n long, timer long")
        self.passed = handle.getListState("path", "place int")

    def _row(self, key: Any, at: int, place: int, n: int, error: str | None = None) -> Row:
        path = [STATES[p[0]] for p in self.passed.get()]
        return Row(id=key[0], status=STATES[place], updated_at=_time(at), n_updates=n, path=path, error_code=error)

    def _set(self, at: int, place: int, n: int, old: int, timer: int) -> None:
        if old != timer:
            if old >= 0:
                self.handle.deleteTimer(old)
            if timer >= 0:
                self.handle.registerTimer(timer)
        self.last.update((at, place, n, timer))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        """Take a job's updates of a batch: later ones, or as late and further on."""
        at, place, n, timer = self.last.get() if self.last.exists() else (-1, -1, 0, -1)
        new, went = (at, place), []
        for when, to in sorted((r["_at"], r["_place"]) for r in rows):
            n += 1
            if (when, to) > new and (place < 0 or STATES[new[1]] not in FINAL):
                if to != new[1]:
                    went.append((to,))
                new = (when, to)
        if went:
            self.passed.appendList(went)
        at, place = new
        state = STATES[place]
        if state in FINAL:
            due = at // 1000 + self.keep_ms
        elif state == "running":
            # from when it began to run, not from its last sign of life
            due = timer if timer >= 0 and not went else at // 1000 + self.run_ms
        else:
            due = -1
        self._set(at, place, n, timer, due)
        yield self._row(key, at, place, n)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        """A running job fails; a finished one leaves."""
        due = expiredTimerInfo.getExpiryTimeInMs()
        at, place, n, timer = self.last.get() if self.last.exists() else (-1, -1, 0, -1)
        if place < 0 or due != timer:
            return
        if STATES[place] in FINAL:
            self.last.clear()
            self.passed.clear()
            return
        failed = STATES.index("failed")
        self.passed.appendValue((failed,))
        self.last.update((due * 1000, failed, n, due + self.keep_ms))
        self.handle.registerTimer(due + self.keep_ms)
        yield self._row(key, due * 1000, failed, n, EXPIRED)

    def close(self) -> None:
        """Nothing is held besides the state."""


def expiring_states(updates: DataFrame, run_limit: timedelta = RUN_LIMIT, keep: timedelta = KEEP, late: str = "10 minutes") -> DataFrame:
    """Each job's state of a stream of updates (id, status, updated_at); a job that runs too long is failed with ``TIMED_OUT``.

    Rows without an id, a time or a known status are left out, and so are updates later
    than the watermark allows. The session must use the store named in ``STORE``.
    """
    place = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("status")) - 1
    rows = updates.select(F.col("id").cast("string").alias("id"), "updated_at", F.unix_micros("updated_at").alias("_at"), place.cast("int").alias("_place"))
    rows = rows.filter("id IS NOT NULL AND updated_at IS NOT NULL AND _place >= 0").withWatermark("updated_at", late)
    return rows.groupBy("id").transformWithState(JobLifecycle(run_limit, keep), OUTPUT, "Update", "EventTime")
