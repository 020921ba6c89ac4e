"""The job queue with timers: leases run out and retries fall due by event time, whether or not a command comes.

A job's state holds one timer, for the end of its lease or for its next attempt. What has fallen due before a command is reported
before the command's own transition; what nothing follows is reported when the watermark has passed it. So the
transitions are the same however commands are cut into batches. Late commands, older than the watermark, are dropped by
Spark, since their job's timers may have fired. State and timers are in the state store, so a stream that is started
again goes on where it was.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor

from recallbase.streaming.queue import STATE, backoff, step

#: What a command or a timer led to. seq is null for timers; at is their deadline, in seconds.
TIMED = "job_id long, seq long, op string, accepted boolean, status string, attempts int, at double"
#: Ticks of periodic work: when it was due, in microseconds, and the last row before that.
TICK = "key long, due long, after long"


def fallen_due(state: tuple, at: float, base: float, most: int) -> Iterator[tuple[str, float, tuple]]:
    """(op, deadline, state after) of what runs out up to `at`: a lease, then perhaps the wait for a retry."""
    status, owner, until, attempts, retry = state
    if status == "claimed" and at >= until:
        over = attempts >= most
        status, owner, retry = ("failed", None, 0.0) if over else ("retry_wait", None, until + backoff(base, attempts))
        yield "lease.expired", until, (status, owner, 0.0, attempts, retry)
    if status == "retry_wait" and at >= retry:
        yield "retry.due", retry, ("queued", None, 0.0, attempts, 0.0)


class QueueTimers(StatefulProcessor):
    """State and timer of one job."""

    def __init__(self, lease: float, base: float, most: int):
        self.lease, self.base, self.most = lease, base, most

    def init(self, handle) -> None:
        self.handle, self.held = handle, handle.getValueState("job", STATE)

    def _state(self) -> tuple:
        return tuple(self.held.get()) if self.held.exists() else ("", None, 0.0, 0, 0.0)

    def _keep(self, state: tuple) -> None:
        """Stores the state and its one timer."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.held.update(state)
        deadline = state[2] if state[0] == "claimed" else state[4] if state[0] == "retry_wait" else None
        if deadline is not None:
            self.handle.registerTimer(math.ceil(deadline * 1000))

    def _due(self, key: tuple, state: tuple, at: float) -> Iterator[tuple[Row, tuple]]:
        for op, deadline, state in fallen_due(state, at, self.base, self.most):
            yield Row(job_id=key[0], seq=None, op=op, accepted=True, status=state[0], attempts=state[3], at=deadline), state

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = self._state()
        for r in sorted(rows, key=lambda r: r.seq):  # of one micro-batch
            for out, state in self._due(key, state, r.seconds):
                yield out
            accepted, state = step(state, r.op, r.worker, r.seconds, self.lease, self.base, self.most)
            yield Row(job_id=key[0], seq=r.seq, op=r.op, accepted=accepted, status=state[0], attempts=state[3], at=r.seconds)
        self._keep(state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self._state()
        for out, state in self._due(key, state, timerValues.getCurrentWatermarkInMs() / 1000):  # a new timer would wait for the next batch
            yield out
        self._keep(state)


def timed_transitions(commands: DataFrame, lease: float = 120.0, base: float = 15.0, most: int = 3) -> DataFrame:
    """Transitions (TIMED) of commands (job_id, seq, op, worker, seconds and `at`, a timestamp with a watermark). Needs the RocksDB state store."""
    rows = commands.select("job_id", "seq", "op", "worker", "seconds", "at")
    return rows.groupBy("job_id").transformWithState(QueueTimers(lease, base, most), TIMED, "Append", "eventTime")


class Periodic(StatefulProcessor):
    """Work that is due every `every` microseconds of event time from a key's first row on, until `idle` microseconds have brought no row."""

    def __init__(self, every: int, idle: int):
        self.every, self.idle = every, idle

    def init(self, handle) -> None:
        self.handle, self.held = handle, handle.getValueState("key", "due long, last long, seq long")

    def _ticks(self, key: tuple, due: int, last: int, seq: int, upto: int) -> Iterator[tuple[Row, int]]:
        while due <= min(upto, last + self.idle):
            yield Row(key=key[0], due=due, after=seq), due + self.every
            due += self.every

    def _keep(self, due: int, last: int, seq: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.held.update((due, last, seq))
        if due <= last + self.idle:
            self.handle.registerTimer(-(-due // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        due, last, seq = self.held.get() if self.held.exists() else (None, None, None)
        for r in sorted(rows, key=lambda r: (r.micros, r.seq)):
            if due is not None:
                for out, due in self._ticks(key, due, last, seq, r.micros):
                    yield out
            if due is None or r.micros > last + self.idle:
                due = r.micros + self.every
            last, seq = r.micros, r.seq
        self._keep(due, last, seq)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due, last, seq = self.held.get()
        for out, due in self._ticks(key, due, last, seq, timerValues.getCurrentWatermarkInMs() * 1000):
            yield out
        self._keep(due, last, seq)


def periodic(rows: DataFrame, every: int, idle: int) -> DataFrame:
    """Ticks (TICK) of maintenance or polling by key, from rows (key, seq, micros, and `at` with a watermark). A key that falls silent gets its ticks by timer until `idle` microseconds have passed, then rests until its next row."""
    return rows.select("key", "seq", "micros", "at").groupBy("key").transformWithState(Periodic(every, idle), TICK, "Append", "eventTime")
