"""The job queue as a stateful stream: commands in, transitions out, a state per job."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

#: A command's columns; what it leads to.
COMMAND = "job_id long, seq long, op string, worker string, at double"
TRANSITION = "job_id long, seq long, op string, accepted boolean, status string, attempts int"
STATE = "status string, worker string, lease_until double, attempts int, retry_at double"


def backoff(base: float, attempts: int) -> float:
    """Seconds until another attempt: doubled each time, six times at most, an hour at most."""
    return min(3600.0, base * 2 ** min(max(attempts - 1, 0), 6))


def step(state: tuple, op: str, worker: str | None, at: float, lease: float, base: float, most: int) -> tuple[bool, tuple]:
    """(accepted, state after) of one command on a job's state (status, worker, lease_until, attempts, retry_at).

    A lease that ran out, and a retry that is due, take effect before the command. Results of a lease that ran out, or of
    another worker, are refused. `enqueue` of a job that is not over changes nothing.
    """
    status, owner, until, attempts, retry = state
    if status == "claimed" and at >= until:
        status, owner, retry = ("failed", None, 0.0) if attempts >= most else ("retry_wait", None, at)
    if status == "retry_wait" and at >= retry:
        status = "queued"
    now = (status, owner, until, attempts, retry)
    if op == "enqueue":
        return (True, ("queued", None, 0.0, 0, 0.0)) if status in ("", "done", "failed", "canceled") else (False, now)
    if op == "claim" and status == "queued":
        return True, ("claimed", worker, at + lease, attempts + 1, 0.0)
    if op in ("done", "error") and status == "claimed" and owner == worker:
        if op == "done":
            return True, ("done", None, 0.0, attempts, 0.0)
        return True, ("failed", None, 0.0, attempts, 0.0) if attempts >= most else ("retry_wait", None, 0.0, attempts, at + backoff(base, attempts))
    if op == "heartbeat" and status == "claimed" and owner == worker:
        return True, (status, owner, at + lease if until - at <= lease / 2 else until, attempts, retry)
    if op == "cancel" and status in ("queued", "claimed", "retry_wait"):
        return True, ("canceled", None, 0.0, attempts, 0.0)
    if op == "retry" and status in ("failed", "canceled"):
        return True, ("queued", None, 0.0, 0, 0.0)
    return False, now


def transitions(commands: DataFrame, lease: float = 120.0, base: float = 15.0, most: int = 3) -> DataFrame:
    """What each command (COMMAND) led to (TRANSITION), in order of seq within a batch. Commands of a job must reach the stream in order; state is kept per job.

    A job's commands come as Arrow batches and are sorted within a micro-batch alone, so what a task holds is bounded by
    the size of a micro-batch.
    """

    def work(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ("", None, 0.0, 0, 0.0)
        rows, out = pd.concat(list(parts)).sort_values("seq", kind="stable"), []
        for seq, op, worker, at in zip(rows["seq"], rows["op"], rows["worker"], rows["at"], strict=True):
            accepted, held = step(tuple(held), op, worker, float(at), lease, base, most)
            out.append((key[0], seq, op, accepted, held[0], held[3]))
        state.update(tuple(held))
        yield pd.DataFrame(out, columns=["job_id", "seq", "op", "accepted", "status", "attempts"])

    return commands.groupBy("job_id").applyInPandasWithState(work, TRANSITION, STATE, "append", "NoTimeout")
