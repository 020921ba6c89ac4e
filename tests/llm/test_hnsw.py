from __future__ import annotations

import numpy as np
import pytest

from recallbase.llm import hnsw
from recallbase.llm.common import shared_dir

VEC = "vec_id long, embedding array<float>, label int, rank int, score double, ids string"


def brute(rows, every, k):
    fine = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, m = np.array([i for i, _ in fine]), np.stack([v for _, v in fine])
    out = {}
    for i, v in fine:
        if i % every == 0:
            s = m @ v
            keep = ids != i
            order = np.lexsort((ids[keep], -s[keep]))[:k]
            out[i] = list(zip(ids[keep][order].tolist(), s[keep][order].tolist(), strict=True))
    return out


def recall(got, want):
    """By score, so that any of several equal neighbours counts."""
    hits = total = 0
    for q, best in want.items():
        if best:
            edge = best[-1][1] - 1e-9
            hits += sum(s >= edge for _, s in got.get(q, []))
            total += len(best)
    return hits / total


def found(df, every=20, k=20):
    out: dict[int, list] = {}
    for r in hnsw.nearest(df, every=every, k=k).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id]) and r.vec_id != r.query_id
    return out


def exact(got, rows):
    at = {i: np.array(v, np.float64) for i, v in rows}
    for q, hits in got.items():
        assert all(np.isclose(s, at[q] @ at[i], rtol=1e-12, atol=1e-12) for i, s in hits)
        assert hits == sorted(hits, key=lambda x: (-x[1], x[0])) and len({i for i, _ in hits}) == len(hits)


@pytest.mark.parametrize(("n", "shard"), [(3000, 500), (2000, 4096)])
def test_recall(spark, monkeypatch, n, shard):
    monkeypatch.setattr(hnsw, "SHARD", shard)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 24))
    rows = [(i, (centers[i % 12] + rng.normal(size=24) * 0.6).astype(np.float32).tolist()) for i in range(n)]
    got = found(spark.createDataFrame([(i, v, 1, 2, 3.0, "x") for i, v in rows], VEC))
    want = brute(rows, 20, 20)
    exact(got, rows)
    assert set(got) == set(want) and recall(got, want) >= 0.95


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = found(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    assert recall(got, brute(rows, 20, 20)) >= 0.95


def test_hot_vector_and_ties(spark):
    rng = np.random.default_rng(4)
    same = rng.normal(size=8).astype(np.float32).tolist()
    rows = [(i, same if i % 3 == 0 else rng.normal(size=8).astype(np.float32).tolist()) for i in range(900)]
    got = found(spark.createDataFrame([(i, v, 1, 2, 3.0, "x") for i, v in rows], VEC))
    want = brute(rows, 20, 20)
    assert recall(got, want) >= 0.95
    for q in (0, 60, 120):
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]


def test_odd_rows_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [3.0, -1.0]), (3, [0.5, 0.5]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 1.0]), (40, [0.0, 0.0]), (60, None), (10, [-1.0, -1.0])]
    got = found(spark.createDataFrame([(i, v, 1, 2, 3.0, "x") for i, v in rows], VEC))
    want = brute(rows, 20, 20)
    assert {q: [i for i, _ in hits] for q, hits in got.items()} == {q: [i for i, _ in hits] for q, hits in want.items()}
    assert hnsw.nearest(spark.createDataFrame([], VEC)).count() == 0
    assert hnsw.nearest(spark.createDataFrame([(20, [1.0], 1, 2, 3.0, "x")], VEC)).count() == 0


def test_index_holds_every_point(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD", 100)
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.normal(size=4 + i % 2).astype(np.float32).tolist(), 1, 2, 3.0, "x") for i in range(700)], VEC)
    folder = shared_dir(spark)
    rows = hnsw.index(hnsw.distinct_points(hnsw.usable(df, "vec_id", "embedding"), 21), folder).collect()
    shards = [hnsw.load(open(r.path, "rb").read()) for r in rows]
    assert sorted(np.concatenate([s[1] for s in shards]).tolist()) == list(range(700)) and len(rows) == 8 and {r.dim for r in rows} == {4, 5}
    for r, (vectors, _, _, layers) in zip(rows, shards, strict=True):
        assert len(layers[0][0]) == len(vectors) == r.n and all((links < r.n).all() and (links[:, 0] >= 0).all() for _, links in layers[:1])


def test_dimensions_are_searched_apart(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=3 if i % 3 else 7).astype(np.float32).tolist()) for i in range(300)]
    got = found(spark.createDataFrame([(i, v, 1, 2, 3.0, "x") for i, v in rows], VEC))
    want = {}
    for d in (3, 7):
        want |= brute([r for r in rows if len(r[1]) == d], 20, 20)
    assert set(got) == set(want) and recall(got, want) >= 0.99


def test_recall_of_a_graph_grown_over_many_batches():
    """Vectors without any clusters, the hardest case, over ten times the first batch."""
    rng = np.random.default_rng(12)
    v = rng.normal(size=(10_000, 48))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    layers = hnsw.build(v, rng.integers(-(2**63), 2**63 - 1, len(v)))
    asked = v[::50]
    rows, _ = hnsw.search(asked, v, layers)
    best = np.argsort(-(asked @ v.T), axis=1)[:, :20]
    assert np.mean([len(set(rows[i, :20].tolist()) & set(best[i].tolist())) / 20 for i in range(len(asked))]) >= 0.95


@pytest.mark.parametrize("sigma", [0.3, 0.6, 1.0])
@pytest.mark.parametrize("clusters", [0, 40])
def test_recall_of_vectors_of_varied_norms(sigma, clusters):
    rng = np.random.default_rng(9)
    n, dim = 4000, 64
    vectors = rng.normal(size=(n, dim))
    if clusters:
        vectors = rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)] + 0.4 * vectors
    vectors *= rng.lognormal(0, sigma, (n, 1)) / np.linalg.norm(vectors, axis=1, keepdims=True)
    layers = hnsw.build(vectors, rng.integers(-(2**63), 2**63 - 1, n))
    asked = vectors[::20]
    rows, _ = hnsw.search(asked, vectors, layers)
    products = asked @ vectors.T
    best = np.argsort(-products, axis=1)[:, :20]
    assert np.mean([len(set(rows[i, :20].tolist()) & set(best[i].tolist())) / 20 for i in range(len(asked))]) >= 0.95


def test_recall_over_shards_of_varied_norms(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD", 1000)
    rng = np.random.default_rng(10)
    vectors = rng.normal(size=(30, 32))[rng.integers(0, 30, 3000)] + 0.3 * rng.normal(size=(3000, 32))
    vectors *= rng.lognormal(0, 1.0, (3000, 1))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(vectors)]
    got = found(spark.createDataFrame([(i, v, 1, 2, 3.0, "x") for i, v in rows], VEC))
    want = brute(rows, 20, 20)
    exact(got, rows)
    assert set(got) == set(want) and recall(got, want) >= 0.95


def ids_found(got, want):
    """Share of the wanted scores, each to a relative hair."""
    hits = total = 0
    for q, best in want.items():
        edge = best[-1][1] - abs(best[-1][1]) * 1e-9
        hits += sum(s >= edge for _, s in got.get(q, []))
        total += len(best)
    return hits / total


@pytest.mark.parametrize("scale", [1e-200, 1e-30, 1e22, 1e150])
def test_any_magnitude(spark, scale):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 16))
    v = (centers[np.arange(1500) % 12] + rng.normal(size=(1500, 16)) * 0.6) * np.exp(0.5 * rng.normal(size=(1500, 1))) * scale
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=50)
    with np.errstate(under="ignore"):
        want = brute(rows, 50, 20)
    if scale == 1e-200:  # all inner products are zero in double precision
        assert got == want
    assert ids_found(got, want) >= 0.95
    layers = hnsw.build(v, rng.integers(-(2**63), 2**63 - 1, len(v)))
    at, _ = hnsw.search(v[::50], v, layers)
    true = hnsw.scaled(v[::50], each=True) @ hnsw.scaled(v).T
    assert np.mean([len({*a[:20].tolist()} & {*np.argsort(-t)[:20].tolist()}) for a, t in zip(at, true, strict=True)]) >= 19


def test_mixed_magnitudes(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(2400, 12)) * 10.0 ** rng.choice((-200, -160, -30, -3, 0, 4, 22, 150, 200), size=(2400, 1))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20)
    with np.errstate(all="ignore"):
        want = brute(rows, 20, 20)
        want = {q: [(i, s) for i, s in best if np.isfinite(s)] for q, best in want.items()}
    assert ids_found(got, {q: best for q, best in want.items() if best}) >= 0.95
