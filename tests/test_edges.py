"""Operators on empty tables, nulls and repeated rows."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from recallbase.operators import aggregates as A
from recallbase.operators import graph as G
from recallbase.operators import jobs as J
from recallbase.operators import lifecycle as L
from recallbase.operators import state as S
from recallbase.operators import vectors as V
from recallbase.sources import logs
from recallbase.streaming import streams

T0 = datetime.datetime(2024, 1, 1)


def test_graphs_of_nothing_and_of_loops(spark):
    nodes, edges = spark.createDataFrame([(1,), (2,), (3,), (3,)], "id long"), spark.createDataFrame([(1, 1, 0.5), (2, 3, 0.9), (3, 2, 0.9)], "a long, b long, weight double")
    assert {(r.id, r.component) for r in G.connected(nodes, edges).collect()} == {(1, 1), (2, 2), (3, 2)}
    none = edges.limit(0)
    assert {(r.id, r.component) for r in G.connected(nodes, none).collect()} == {(1, 1), (2, 2), (3, 3)}
    assert G.connected(nodes.limit(0), none).count() == 0 and G.degrees(none).count() == 0
    assert {(r.id, r.depth) for r in G.reachable(nodes.where("id = 2"), edges, 3).collect()} == {(2, 0), (3, 1)}


def test_components_of_a_long_path(spark):
    n = 300
    nodes = spark.range(n)
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert G.connected(nodes, edges).where("component <> 0").count() == 0


def test_search_without_usable_vectors(spark):
    base = spark.createDataFrame([(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, 0.0]), (5, [1.0])], "id long, vector array<float>")
    q = base.selectExpr("id as query_id", "vector").where("id in (4, 1)")
    assert V.neighbours(q, base, 3).count() == 0
    assert V.neighbours(q.limit(0), base, 3).count() == 0 and V.neighbours(q, base.limit(0), 3).count() == 0
    assert V.centroids(base.withColumn("k", F.lit(1)).where("size(vector) = 2"), "k").first().vector == [0.5, 0.0]


def test_blocks_of_queries(spark):
    from recallbase.operators.shared import in_blocks, small

    rows = spark.range(50)
    got = in_blocks(spark.range(37).withColumnRenamed("id", "q"), "q", rows.join, size=5)
    assert got.count() == 37 * 50 and got.distinct().count() == 37 * 50
    assert "Broadcast" in rows.join(small(spark.range(3), 5), "id")._jdf.queryExecution().toString()


def test_aggregates_of_nothing(spark):
    none = spark.createDataFrame([], "a string, b string")
    assert A.counts_by(none, "a", "b").count() == 0
    assert A.counts_by(spark.createDataFrame([(None, "x"), (None, "y")], "a string, b string"), "a", "b").count() == 3
    ranked = spark.createDataFrame([], "case_id long, rank int")
    assert A.reciprocal_rank(ranked, 5).first().cases == 0


def test_jobs(spark):
    jobs = spark.createDataFrame([(1, "done"), (2, "failed"), (3, "queued")], "id long, status string")
    deps = spark.createDataFrame([(10, 1), (11, 1), (11, 2), (12, 3), (13, 99)], "id long, depends_on long")
    assert {(r.id, r.state) for r in J.dependency_state(jobs, deps).collect()} == {(10, "ready"), (11, "failed"), (12, "wait"), (13, "failed")}
    rows = spark.createDataFrame([(1, "cpu", 5, T0), (2, "cpu", 5, T0), (3, "gpu", 1, T0)], "id long, resource string, priority int, created_at timestamp_ntz").withColumn("status", F.lit("queued"))
    workers = spark.createDataFrame([("w1", "cpu"), ("w2", "tpu")], "worker string, resource string")
    assert [(r.worker, r.id) for r in J.claims(rows, workers).collect()] == [("w1", 1)]


def test_logs_fold_in_any_order(spark):
    log = [("k", 1, "upsert", 5, "a"), ("k", 2, "add", 3, None), ("k", 3, "replace", 7, "b"), ("k", 4, "add", 2, None), ("x", 5, "add", 9, None), ("y", 6, "upsert", 1, "c"), ("y", 7, "delete", 0, None), ("z", 8, "upsert", 2, None)]
    df = spark.createDataFrame(log, "key string, seq long, op string, delta long, payload string")
    want = {("k", "b", 9, 3), ("z", None, 2, 8)}
    for part in (df, df.orderBy(F.desc("seq")).repartition(5)):
        assert {tuple(r) for r in logs.apply_events(part, "key", "seq").collect()} == want
    assert logs.apply_events(df.limit(0), "key", "seq").count() == 0
    segments = spark.createDataFrame([(1, 5, 1, False), (1, 5, 2, True), (2, 1, 3, False), (2, 0, 4, True)], "id long, revision long, place long, deleted boolean")
    assert [r.id for r in logs.latest_records(segments).collect()] == [2]


def test_state_changes_of_nothing(spark):
    rows = spark.createDataFrame([], "id long, text string, source string, base double")
    assert S.learn(rows, 10, [], {}, 0.5).count() == 0
    same = spark.createDataFrame([(3, "A ", "s", 0.0), (1, "a", "s", 0.4), (2, "", "s", 1.0), (4, None, "s", 1.0)], "id long, text string, source string, base double")
    assert [(r.id, r.repeats, r.confidence) for r in S.learn(same, 10, [], {"s": 0.5}, 0.9).collect()] == [(1, 1, 0.2)]
    old = spark.createDataFrame([(1, "a"), (2, None)], "id long, hash string")
    assert {(r.id, r.action) for r in S.reconcile(old, old).collect()} == {(1, "unchanged"), (2, "unchanged")}
    assert {r.action for r in S.reconcile(old, old.limit(0)).collect()} == {"deleted"}
    assert L.corroborate(spark.createDataFrame([(1, 0.5, 2.49)], "id long, confidence double, salience double"), spark.createDataFrame([(1, 7, 1.0), (1, 7, 0.2), (1, 8, 1.0)], "id long, source_id long, weight double")).first().sources == 2


def test_streams_drop_rows_without_a_time(spark, tmp_path):
    spark.createDataFrame([(1, T0), (2, None), (3, T0 + datetime.timedelta(days=9))], "id long, ts timestamp_ntz").write.parquet(str(tmp_path / "in"))
    rows = streams.event_time(streams.table_stream(spark, str(tmp_path / "in")), "ts", "1 day")
    assert [r.n for r in streams.drain(streams.tumbling(rows, "1 day", [], F.count("*").alias("n")), "t").collect()] == [1]
