"""The change feed by offset, fenced results, and the meta-search query's source, each against plain code."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from recallbase.sources import feed
from recallbase.streaming import fenced, streams


def records(rows, spark):
    return spark.createDataFrame(rows, "seq long, id long, body string")


def test_a_feed_is_read_once_and_goes_on(spark, tmp_path):
    folder = f"file://{tmp_path}/feed"
    seen = []

    def pull():
        def work(batch, number):
            seen.append((number, sorted((r.seq, r.id, r.body) for r in batch.collect())))

        streams.each_batch(feed.read_stream(spark, folder), f"{tmp_path}/offsets", work)

    first = [(i, i % 50, f"b{i}\nä \"") for i in range(0, 250, 2)]
    feed.publish(records(first, spark), folder, page=40)
    pull()
    pull()  # nothing new
    assert [r for _, rows in seen for r in rows] == first
    later = [(i, i % 50, None if i % 3 else "x") for i in range(1000, 1100)]
    feed.publish(records(later, spark), folder, page=40)
    pull()
    assert [r for _, rows in seen for r in rows] == first + later
    assert sorted((r.seq, r.id, r.body) for r in feed.read(spark, folder).collect()) == first + later
    assert feed.read(spark, folder).rdd.getNumPartitions() == 7 + 3  # a page is a task


def test_an_empty_feed(spark, tmp_path):
    folder = f"file://{tmp_path}/feed"
    assert feed.read(spark, folder).count() == 0
    state = streams.merge_latest(feed.read_stream(spark, folder), f"file://{tmp_path}/sync", "id", "seq")
    assert state.count() == 0 and state.columns == ["seq", "id", "body"]


def test_pages_are_cut_at_the_offset(spark, tmp_path):
    """A page that grew into a batch's end is read up to there, the rest in the next."""
    reader = feed.FeedStream(f"file://{tmp_path}/feed")
    feed.publish(records([(i, i, "x") for i in range(10)], spark), f"file://{tmp_path}/feed", page=100)
    rows = lambda a, b: [r[0] for p in reader.partitions({"seq": a}, {"seq": b}) for r in reader.read(p)]
    assert reader.latestOffset() == {"seq": 9} and rows(-1, 4) == [0, 1, 2, 3, 4] and rows(4, 9) == [5, 6, 7, 8, 9] and rows(9, 9) == []


def plain(jobs, batches):
    state = {i: [status, token, None, None, 0] for i, status, token in jobs}
    for batch in batches:
        for seq, i, token, ok, result in sorted(batch):
            if i in state:
                s = state[i]
                if s[0] == "claimed" and token is not None and s[1] == token:
                    state[i] = ["done" if ok else "failed", None, result, seq, s[4]]
                else:
                    s[4] += 1
    return {i: tuple(s) for i, s in state.items()}


RESULT = "seq long, id long, token long, ok boolean, result string"


def test_fenced_results(spark, tmp_path):
    rng = random.Random(2)
    jobs = [(i, rng.choice(("claimed", "claimed", "queued", "done")), i * 10 if i % 9 else None) for i in range(60)]
    batches = [[(100 * b + k, rng.randrange(65), (i := rng.randrange(60)) and None, bool(rng.random() < 0.8), f"r{b}-{k}") for k in range(60)] for b in range(3)]
    batches = [[(s, i, rng.choice((i * 10, i * 10, 7, None)), ok, r) for s, i, _, ok, r in batch] for batch in batches]
    df = spark.createDataFrame(jobs, "id long, status string, token long").withColumns({"result": F.lit(None).cast("string"), "accepted_seq": F.lit(None).cast("long"), "refused": F.lit(0).cast("long")})
    folder = f"file://{tmp_path}/state"
    for b, batch in enumerate(batches):
        spark.createDataFrame(batch, RESULT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = fenced.apply_results(streams.table_stream(spark, f"{tmp_path}/in", files_per_batch=1), df, folder)
        now = {r.id: (r.status, r.token, r.result, r.accepted_seq, r.refused) for r in got.collect()}
        want = plain(jobs, batches[: b + 1])
        assert {i: (s[0], s[2], s[3], s[4]) for i, s in now.items()} == {i: (s[0], s[2], s[3], s[4]) for i, s in want.items()}
    again = fenced.apply_results(streams.table_stream(spark, f"{tmp_path}/in", files_per_batch=1), df, folder)  # nothing new
    assert {r.id: (r.status, r.refused) for r in again.collect()} == {i: (s[0], s[4]) for i, s in want.items()}


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    jobs = spark.createDataFrame([(1, "claimed", 5, None, None, 0), (2, "claimed", 6, None, None, 0)], fenced.JOB)
    batch = spark.createDataFrame([(10, 1, 5, True, "a"), (11, 1, 5, True, "b"), (12, 2, 5, True, "c")], RESULT)
    once = fenced.settle(jobs, batch)
    assert sorted(tuple(r) for r in once.collect()) == [(1, "done", None, "a", 10, 1), (2, "claimed", 6, None, None, 1)]
    assert sorted(tuple(r) for r in fenced.settle(jobs, batch).collect()) == sorted(tuple(r) for r in once.collect())  # a version comes of the one before it
    late = fenced.settle(once, spark.createDataFrame([(13, 1, 5, True, "late"), (14, 2, 6, False, "x"), (15, 3, 1, True, "y")], RESULT))
    assert sorted(tuple(r) for r in late.collect()) == [(1, "done", None, "a", 10, 2), (2, "failed", None, "x", 14, 1)]
