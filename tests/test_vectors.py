"""Exact and quantised vector search against numpy."""

from __future__ import annotations

import numpy as np

from recallbase.operators import clustering
from recallbase.operators import quantized as Q
from recallbase.operators import vectors as V

VEC = "id long, vector array<float>"


def plain_kmeans(x, centers, rounds):
    x, centers = x.astype(np.float64), centers.astype(np.float64).copy()
    for _ in range(rounds):
        own = np.array([int(((v - centers) ** 2).sum(1).argmin()) for v in x])
        for j in range(len(centers)):
            if (own == j).any():
                centers[j] = x[own == j].mean(0)
    return centers


def farthest(x, k):
    """Seeds one by one, each the row farthest from those before."""
    centers = [x[0]]
    while len(centers) < k:
        d = np.min([((x - c) ** 2).sum(1) for c in centers], axis=0)
        centers.append(x[int(d.argmax())])
    return np.array(centers)


def error(x, centers):
    return clustering.distances(x, centers).min(1).sum()


def test_rounds_over_all_rows_are_the_plain_loop(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6)).astype(np.float32)
    start = x[:7].copy()
    start[6] = 100.0  # gets no row and stays
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VEC)
    (got,) = clustering.lloyd(df.repartition(5), [start], 4)
    assert np.allclose(got, plain_kmeans(x, start, 4), atol=1e-8) and (got[6] == 100).all()
    (other,) = clustering.lloyd(df.repartition(3, "id"), [start], 4)
    assert np.array_equal(got, other)  # however rows lie
    pair = clustering.lloyd(df, [start[:6, :2], start[:5, 2:]], 3, lambda t: [t[:, :2], t[:, 2:]])
    assert np.allclose(pair[0], plain_kmeans(x[:, :2], start[:6, :2], 3), atol=1e-8) and np.allclose(pair[1], plain_kmeans(x[:, 2:], start[:5, 2:], 3), atol=1e-8)
    assert Q.bounds(10, 4) == [(0, 3), (3, 6), (6, 8), (8, 10)]


def test_seeds_find_the_clusters(spark):
    rng = np.random.default_rng(3)
    centers = 4 * rng.normal(size=(9, 5))
    x = centers[rng.choice(9, 900, p=[0.6] + [0.05] * 8)] + 0.1 * rng.normal(size=(900, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    (start,) = clustering.seeds(df.repartition(4), 9)
    assert len(start) == 9 and sorted(clustering.nearest(start, centers)) == list(range(9))
    assert np.array_equal(start, clustering.seeds(df.repartition(7), 9)[0])
    assert len(clustering.seeds(df.limit(3), 9)[0]) == 3 and len(clustering.seeds(df.where("id < 1").union(df.where("id < 1")), 4)[0]) == 1
    (got,) = clustering.lloyd(df, [start], 8)
    assert error(x, got) <= 1.05 * error(x, plain_kmeans(x, farthest(x, 9), 8))


def test_quantised_candidates_hold_the_neighbours(spark, tmp_path):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(20, 16))
    rows = [(i, (centers[i % 20] + 0.4 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(2000)]
    df = spark.createDataFrame([*rows, (5000, []), (5001, None), (5002, [0.0] * 16)], VEC)
    model = Q.train(df, cells=32, parts=4, codes=32)
    Q.write_index(df, model, str(tmp_path / "cells"))
    q = df.where("id % 50 = 0 and id < 2000").selectExpr("id as query_id", "vector")
    found = Q.search(spark, str(tmp_path / "cells"), model, q, k=100, probes=12)
    exact = V.neighbours(q, df, 10)
    assert V.recall(found, exact, 10).first()[0] >= 0.9
    assert found.where("rank > 100 or id = query_id").count() == 0


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VEC)
    q = df.where("id % 50 = 0").selectExpr("id as query_id", "vector")
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    for block in (4096, 2):
        monkeypatch.setattr(V, "QUERY_BLOCK", block)
        got: dict[int, list] = {}
        for r in V.neighbours(q, df, 5, 0.1).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        for i in range(0, 300, 50):
            s = u @ u[i]
            want = [j for j in np.lexsort((np.arange(300), -s)).tolist() if j != i and s[j] >= 0.1][:5]
            assert got.get(i, []) == want


def test_equal_neighbours_go_by_id(spark):
    rng = np.random.default_rng(4)
    ids = rng.permutation(400).tolist()
    df = spark.createDataFrame([(i + 1, [1.0, 2.0]) for i in ids] + [(900, [2.0, 1.0]), (901, [2.0, 4.0])], VEC).repartition(3)
    got = V.neighbours(df.where("id = 900").selectExpr("id as query_id", "vector"), df, 5).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 2, 3, 4, 5]
    sim = np.array([[0.5, 0.9, 0.5, -np.inf, 0.5, 0.9 + 1e-12]])
    assert V._best(sim, 4)[1].tolist() == [0, 1, 2, 5] and V._best(sim, 9)[1].tolist() == [0, 1, 2, 4, 5]


def test_search_in_blocks_gives_the_same(spark, sf_dir, monkeypatch):
    from recallbase.plans import load

    one = sorted(map(tuple, load().QUERIES["v03_vector_search"](spark, sf_dir).select("query_id", "rank", "id").collect()))
    monkeypatch.setattr(V, "QUERY_BLOCK", 1)
    assert sorted(map(tuple, load().QUERIES["v03_vector_search"](spark, sf_dir).select("query_id", "rank", "id").collect())) == one
