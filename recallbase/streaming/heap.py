"""A priority queue as keyed state: a bounded heap per queue, one pending entry per key, first in first out within a priority.

A queue is one key of the stream, so a service deals its work over as many queues as it wants tasks; a queue's state holds
at most `limit` entries and the keys of those that were taken and aren't done.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: What a command led to: ok, duplicate, full, taken (with the entry's key), empty, done or unknown; and the entries left.
ANSWER = "queue long, seq long, op string, answer string, item long, waiting int"
#: Entries (-priority, number of arrival, key) and the keys that are waiting or taken.
HEAP = "numbered long, entries array<struct<rank: int, number: long, item: long>>, pending array<long>"

#: Answers that are handed on at once.
TOLD = 10_000


def command(heap: list[tuple], pending: set[int], numbered: int, op: str, item: int | None, priority: int, limit: int) -> tuple[str, int | None, int]:
    """(answer, item, numbered) of one command; changes heap and pending.

    `offer` takes an entry unless its key is pending or the queue is full; `take` gives the entry of the highest priority that came
    first; `done` frees a key that was taken, so that it may be offered again.
    """
    if op == "offer":
        if item in pending:
            return "duplicate", item, numbered
        if len(heap) >= limit:
            return "full", item, numbered
        pending.add(item)
        heapq.heappush(heap, (-priority, numbered, item))
        return "ok", item, numbered + 1
    if op == "take":
        return ("taken", heapq.heappop(heap)[2], numbered) if heap else ("empty", None, numbered)
    if item in pending and all(e[2] != item for e in heap):
        pending.discard(item)
        return "done", item, numbered
    return "unknown", item, numbered


class Heap(StatefulProcessor):
    """The state of one queue."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle) -> None:
        self.held = handle.getValueState("heap", HEAP)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        numbered, entries, pending = self.held.get() if self.held.exists() else (0, [], [])
        heap, pending = [tuple(e) for e in entries], set(pending)
        heapq.heapify(heap)
        ops: dict[str, int] = {}
        held = [(r["seq"].to_numpy(), np.array([ops.setdefault(o, len(ops)) for o in r["op"]], np.int8), r["item"].to_numpy(), r["none"].to_numpy(bool), r["priority"].to_numpy()) for r in rows]
        seq, op, item, none, priority = (np.concatenate(x) for x in zip(*held, strict=True))  # of one micro-batch, 22 bytes a command
        del held
        order, names = np.argsort(seq, kind="stable"), list(ops)
        for at in range(0, len(order), TOLD):
            part, told = order[at : at + TOLD], []
            for i in part.tolist():
                answer, which, numbered = command(heap, pending, numbered, names[op[i]], None if none[i] else int(item[i]), int(priority[i]), self.limit)
                told.append((names[op[i]], answer, which, len(heap)))
            what, answers, items, waiting = zip(*told, strict=True)
            yield pd.DataFrame({"queue": key[0], "seq": seq[part], "op": what, "answer": answers, "item": pd.array(items, dtype="Int64"), "waiting": np.array(waiting, np.int32)})
        self.held.update((numbered, sorted(heap), sorted(pending)))


def answers(commands: DataFrame, limit: int = 100) -> DataFrame:
    """ANSWER of each command (queue, seq, op, item, priority). Commands of a queue must reach the stream in order; without a priority it is 0. Needs the RocksDB state store."""
    item, priority = F.coalesce(F.col("item").cast("long"), F.lit(0).cast("long")), F.coalesce(F.col("priority").cast("int"), F.lit(0))
    rows = commands.select("queue", F.col("seq").cast("long").alias("seq"), "op", item.alias("item"), F.col("item").isNull().alias("none"), priority.alias("priority"))
    return rows.groupBy("queue").transformWithStateInPandas(Heap(limit), ANSWER, "Append", "None")
