"""Waiting until a whole stream is quiet.

A listener notes when the stream last had rows: the end of its last batch with rows, or the
newest arrival that the batch reports, whichever is later. That is one clock for all strata,
so a stratum that gets a row now and then stays open while any row arrives, and a slow batch
counts as activity until it ends.
"""

from __future__ import annotations

import threading
import time
from datetime import datetime

from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: How long to wait for a batch that is running, or for a first row, before looking again.
RECHECK_S = 1.0
#: A trigger without rows takes a few milliseconds; look again after this time.
TRIGGER_S = 0.02


def _seconds(timestamp: str) -> float:
    return datetime.fromisoformat(timestamp.replace("Z", "+00:00")).timestamp()


class Clock(StreamingQueryListener):
    """When one run of a query last had rows, and when it was last seen without any."""

    def __init__(self, run_id: str):
        self.run_id = run_id
        self.changed = threading.Condition()
        self.last_rows: float | None = None
        self.idle_from = float("-inf")
        self.ended = False

    def _note(self, started: str, duration_ms: int, rows: int, newest: str | None) -> None:
        with self.changed:
            if rows:
                end = _seconds(started) + duration_ms / 1000
                arrived = _seconds(newest) if newest else end
                self.last_rows = max(self.last_rows or 0.0, end, arrived)
            else:  # a batch that began when there was nothing to read
                self.idle_from = max(self.idle_from, _seconds(started))
            self.changed.notify_all()

    def note_past(self, query: StreamingQuery) -> None:
        """Take in the batches that ended before this clock was listening."""
        for p in query.recentProgress:
            self._note(p["timestamp"], p["batchDuration"], p["numInputRows"], p["eventTime"].get("max"))

    def onQueryStarted(self, event) -> None:
        """Nothing to note: a query without rows has not begun."""

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if str(p.runId) == self.run_id:
            self._note(p.timestamp, p.batchDuration, p.numInputRows, p.eventTime.get("max"))

    def onQueryIdle(self, event) -> None:
        if str(event.runId) == self.run_id:
            with self.changed:
                self.idle_from = max(self.idle_from, _seconds(event.timestamp))
                self.changed.notify_all()

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == self.run_id:
            with self.changed:
                self.ended = True
                self.changed.notify_all()


def await_idle(query: StreamingQuery, quiet_ms: int, limit_s: float | None = None, after: float = 0.0) -> bool:
    """Wait until a query had rows and then none for ``quiet_ms``.

    True once that holds and no batch is running, or Spark reports an idle trigger after the
    quiet time; False after ``limit_s`` seconds, if given. A stream that never has a row is
    not idle but not begun; with ``after`` (seconds since 1970) rows up to then do not count.
    An exception of the query is raised. Batches are told by a listener, which is removed
    at the end.
    """
    deadline = float("inf") if limit_s is None else time.time() + limit_s
    clock = Clock(str(query.runId))
    streams = query.sparkSession.streams if hasattr(query, "sparkSession") else _streams()
    streams.addListener(clock)
    try:
        clock.note_past(query)
        with clock.changed:
            while time.time() < deadline:
                if query.exception() is not None:
                    raise query.exception()
                begun = clock.last_rows is not None and clock.last_rows > after
                if not begun and clock.ended:
                    return False
                wait = RECHECK_S
                if begun:
                    due = clock.last_rows + quiet_ms / 1000
                    status = query.status
                    running = status["isTriggerActive"] or status["isDataAvailable"]
                    if time.time() < due:
                        wait = due - time.time()
                    elif clock.idle_from > due or clock.ended or not running:
                        return True
                    else:
                        wait = TRIGGER_S
                clock.changed.wait(min(wait, max(0.0, deadline - time.time())))
        return False
    finally:
        streams.removeListener(clock)


def _streams():
    from pyspark.sql import SparkSession

    return SparkSession.active().streams
