"""Timers, periodic work and the priority queue as streams: restarts, cuts into batches, plain loops."""

from __future__ import annotations

import heapq
import random

import pytest
from pyspark.sql import functions as F

from recallbase.streaming import heap, queue, streams, timers


def run(stream, folder):
    stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()


def put(spark, rows, schema, folder, names):
    """A file for each name, in order of names and time of writing."""
    for name, part in zip(names, rows, strict=True):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/{name}")


COMMAND = "job_id long, seq long, op string, worker string, seconds double"


def commands(n, seed):
    rng, t = random.Random(seed), 1_700_000_000.0
    out = []
    for i in range(n):
        t += rng.choice((1, 5, 40, 300))
        out.append((rng.randint(0, 7), i, rng.choice(("enqueue", "claim", "claim", "done", "error", "heartbeat", "cancel", "retry")), rng.choice("ab"), t))
    return out


def plain(rows, edge, lease, base, most):
    """All transitions by one loop over commands; what is due before `edge` fires in the end."""
    state, out = {}, []
    for job, seq, op, worker, at in rows:
        s = state.get(job, ("", None, 0.0, 0, 0.0))
        for name, deadline, s in timers.fallen_due(s, at, base, most):
            out.append((job, None, name, True, s[0], s[3], deadline))
        ok, s = queue.step(s, op, worker, at, lease, base, most)
        out.append((job, seq, op, ok, s[0], s[3], at))
        state[job] = s
    for job, s in state.items():
        for name, deadline, s in timers.fallen_due(s, edge, base, most):
            out.append((job, None, name, True, s[0], s[3], deadline))
    return sorted(out, key=str)


@pytest.mark.parametrize("cuts", [1, 3])
def test_timers_survive_a_restart_and_any_cut(spark, tmp_path, cuts):
    """The stream stops after each part and goes on from its checkpoint; the state, its timers included, is there."""
    rows = commands(160, 3)
    size = -(-len(rows) // cuts)
    parts = [rows[a : a + size] for a in range(0, len(rows), size)]
    for i, part in enumerate(parts):
        put(spark, [part], COMMAND, f"{tmp_path}/in", [f"{i}"])
        source = spark.readStream.schema(COMMAND).parquet(f"{tmp_path}/in/*")
        with streams.rocksdb(spark):
            run(timers.timed_transitions(streams.event_time(source.withColumn("ts", F.timestamp_seconds("seconds")), "ts", "0 seconds"), 100.0, 20.0, 3), f"{tmp_path}/out")
    got = sorted((tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/rows").collect()), key=str)
    assert got == plain(rows, rows[-1][4], 100.0, 20.0, 3)
    assert sum(r[2] == "lease.expired" for r in got) > 5 and sum(r[2] == "retry.due" for r in got) > 5


def test_a_lease_ends_with_no_command_at_hand(spark, tmp_path):
    """Job 1 is claimed and never heard of again; commands of others move time on."""
    rows = [(1, 0, "enqueue", "a", 1000.0), (1, 1, "claim", "a", 1010.0), (2, 2, "enqueue", "b", 1500.0), (3, 3, "enqueue", "b", 1900.0)]
    put(spark, [rows], COMMAND, f"{tmp_path}/in", ["0"])
    source = spark.readStream.schema(COMMAND).parquet(f"{tmp_path}/in/*")
    with streams.rocksdb(spark):
        run(timers.timed_transitions(streams.event_time(source.withColumn("ts", F.timestamp_seconds("seconds")), "ts", "0 seconds"), 100.0, 20.0, 3), f"{tmp_path}/out")
    got = [(r.op, r.at, r.status) for r in spark.read.parquet(f"{tmp_path}/out/rows").where("job_id = 1").orderBy("at").collect()]
    assert got == [("enqueue", 1000.0, "queued"), ("claim", 1010.0, "claimed"), ("lease.expired", 1110.0, "retry_wait"), ("retry.due", 1130.0, "queued")]


def test_fallen_due():
    assert list(timers.fallen_due(("claimed", "w", 10.0, 3, 0.0), 10.0, 5.0, 3)) == [("lease.expired", 10.0, ("failed", None, 0.0, 3, 0.0))]
    assert [x[:2] for x in timers.fallen_due(("claimed", "w", 10.0, 1, 0.0), 99.0, 5.0, 3)] == [("lease.expired", 10.0), ("retry.due", 15.0)]
    assert not list(timers.fallen_due(("claimed", "w", 10.0, 1, 0.0), 9.9, 5.0, 3)) and not list(timers.fallen_due(("done", None, 0.0, 1, 0.0), 9e9, 5.0, 3))


def test_periodic_work_rests_when_idle(spark, tmp_path):
    s = 1_000_000
    put(spark, [[(1, i, (1000 + t) * s) for i, t in enumerate((0, 25, 200))] + [(2, i, (1000 + t) * s) for i, t in ((3, 205), (4, 400))]], "key long, seq long, micros long", f"{tmp_path}/in", ["0"])
    source = spark.readStream.schema("key long, seq long, micros long").parquet(f"{tmp_path}/in/*")
    with streams.rocksdb(spark):
        run(timers.periodic(streams.event_time(source.withColumn("ts", F.timestamp_micros("micros")), "ts", "0 seconds"), 10 * s, 30 * s), f"{tmp_path}/out")
    got = sorted((r.key, r.due // s - 1000, r.after) for r in spark.read.parquet(f"{tmp_path}/out/rows").collect())
    assert got == [(1, 10, 0), (1, 20, 0), *[(1, t, 1) for t in (30, 40, 50)], *[(1, t, 2) for t in (210, 220, 230)], *[(2, t, 3) for t in (215, 225, 235)]]


def test_heap_is_a_plain_heap(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randint(0, 2), i, rng.choice(("offer", "offer", "offer", "take", "done")), rng.randint(0, 12), rng.choice((10, 20, 80))) for i in range(300)]
    schema = "queue long, seq long, op string, item long, priority int"
    for i in range(2):
        put(spark, [rows[150 * i : 150 * (i + 1)]], schema, f"{tmp_path}/in", [f"{i}"])
        with streams.rocksdb(spark):
            run(heap.answers(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), limit=4), f"{tmp_path}/out")
    want, waiting, busy = [], {}, {}
    for q, seq, op, item, priority in rows:
        w, b = waiting.setdefault(q, []), busy.setdefault(q, set())
        if op == "offer":
            answer = "duplicate" if item in b or item in [x[2] for x in w] else "full" if len(w) == 4 else "ok"
            if answer == "ok":
                heapq.heappush(w, (-priority, seq, item))
        elif op == "take":
            answer, item = ("taken", heapq.heappop(w)[2]) if w else ("empty", None)
            b.add(item)
        else:
            answer = "done" if item in b else "unknown"
            b.discard(item)
        want.append((q, seq, op, answer, item, len(w)))
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/rows").collect()) == sorted(want)
    assert {r[3] for r in want} == {"ok", "duplicate", "full", "taken", "empty", "done", "unknown"}


def test_heap_order():
    """Priority first, then arrival; a key under another trigger is another key."""
    h, pending, n = [], set(), 0
    for item, priority in ((1, 10), (2, 80), (3, 80)):
        answer, _, n = heap.command(h, pending, n, "offer", item, priority, 10)
        assert answer == "ok"
    assert [heap.command(h, pending, n, "take", None, 0, 10)[1] for _ in range(3)] == [2, 3, 1]
    assert heap.command(h, pending, n, "offer", 2, 10, 10)[0] == "duplicate" and heap.command(h, pending, n, "done", 2, 0, 10)[0] == "done"
    assert heap.command(h, pending, n, "offer", 2, 10, 10)[0] == "ok"
