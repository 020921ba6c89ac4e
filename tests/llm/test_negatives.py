"""Hard negatives by pivots against all pairs, and the brackets against exact scores."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from recallbase.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score double, cell int, block long, lo array<double>, place int"


def floors(v, scale=256):
    return [math.floor(scale * x) for x in v]


def expected(rows, every=100, positives=5, k=10, low=30, high=90, scale=256):
    live = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = floors(v, scale)
        if sum(x * x for x in w) < 1 << 62:
            live.append((i, w, label))
    out = Counter()
    for a in {r[0] for r in live if r[0] % every == 0}:
        _, q, label = min((r for r in live if r[0] == a), key=lambda r: (r[2], r[1]))
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, other) for i, v, other in live if len(v) == len(q) and i != a)
        for s, p, _ in [r for r in scored if r[2] == label][:positives]:
            hard = [(-t, i) for t, i, other in scored if other != label and low * -s <= 100 * -t <= high * -s][:k]
            out.update((a, p, rank + 1, i, -s, t) for rank, (t, i) in enumerate(hard))
    return out


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1.0, 2, 3, [4.0], 5) for r in rows], SCHEMA).repartition(4)
    return Counter(tuple(r) for r in negatives.mine(df, **options).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def clusters(rng, n, dim=8, norms=0.0):
    centres = rng.normal(size=(6, dim))
    which = rng.integers(0, 6, n)
    v = centres[which] + 0.4 * rng.normal(size=(n, dim))
    v = v / np.linalg.norm(v, axis=1, keepdims=True) * np.exp(norms * rng.normal(size=(n, 1)))
    return v, which


@pytest.mark.parametrize("norms", [0.0, 1.0])
def test_equal_to_all_pairs(spark, monkeypatch, norms):
    monkeypatch.setattr(negatives, "BLOCK", 150)
    monkeypatch.setattr(negatives, "RUN", 8)
    rng = np.random.default_rng(7)
    v, which = clusters(rng, 1200, norms=norms)
    rows = [(i * 5, v[i].tolist(), int((which[i] + (rng.random() < 0.3)) % 6)) for i in range(1200)]
    want = expected(rows)
    assert len(want) > 500
    assert found(spark, rows) == want


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 40)
    rng = np.random.default_rng(8)
    v, which = clusters(rng, 240, dim=3)
    rows = [(i, v[i].tolist(), int(which[i] % 2)) for i in range(240)]
    rows += [(1000 + i, [0.5, -0.25, 1.0], i % 3) for i in range(150)]  # one vector with a third of all rows
    rows += [(0, v[3].tolist(), 1), (7, v[7].tolist(), 0), (7, v[7].tolist(), 0), (100, None, 1), (None, v[0].tolist(), 1), (2000, [0.1, 0.2, 0.3], None)]
    rows += [(2100, [float("nan"), 0.0, 1.0], 1), (2200, [float("inf"), 0.0, 1.0], 1), (2300, [None, 0.0, 1.0], 1), (2400, [0.0, 0.0, 0.0], 1), (-100, [-0.9, 0.1, 0.2], 0), (2500, [1e300, 0.0, 0.0], 0)]
    rows += [(3000 + i, [0.1 * i, 1.0], i % 2) for i in range(5)] + [(4000, [], 1), (4001, [], 1), (4002, [], 0), (5000, [1.0], 1)]
    assert found(spark, rows, every=20) == expected(rows, every=20)
    assert found(spark, rows, every=50, positives=2, negatives=3, low=0, high=100) == expected(rows, every=50, positives=2, k=3, low=0, high=100)
    assert not found(spark, [])
    assert not found(spark, [(100, None, 1)])


def test_large_numbers_are_exact(spark):
    rng = np.random.default_rng(9)
    v, which = clusters(rng, 300, dim=4)
    rows = [(i, (v[i] * 2.0**21.5).tolist(), int(which[i] % 3)) for i in range(300)]
    want = expected(rows, every=30)
    assert want and max(abs(r[4]) for r in want) > 1 << 53
    assert found(spark, rows, every=30) == want


@pytest.mark.parametrize(("norms", "told"), [(0.0, 0.3), (0.7, 0.0)])
def test_brackets_hold_exact_scores(norms, told):
    rng = np.random.default_rng(10)
    points = np.floor(256 * clusters(rng, 500, norms=norms)[0])
    norm2 = (points**2).sum(1)
    m2 = norm2.max()
    tail = np.sqrt(m2 - norm2)
    at = negatives.choose_pivots(points, tail, 16)
    assert len(set(at.tolist())) == 16
    pivots = np.concatenate([points[at], tail[at, None]], 1)
    far, asked = negatives.distances(points, tail, pivots), negatives.distances(points, np.zeros(500), pivots)
    missed = []
    for q in range(0, 500, 25):
        low, high = negatives.brackets(far, far, asked[q], norm2[q] + m2)
        exact = points @ points[q]
        assert (low <= exact).all() and (exact <= high).all()
        leaf_low, leaf_high = negatives.brackets(far.min(0), far.max(0), asked[q], norm2[q] + m2)
        assert leaf_low <= exact.min() and exact.max() <= leaf_high
        missed.append((high < np.sort(exact)[-20]).mean())
    assert np.mean(missed) >= told  # rows that needn't be read
