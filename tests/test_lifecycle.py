"""Order-dependent lifecycle operators against plain loops over rows."""

from __future__ import annotations

import datetime
import random

import pytest

from recallbase.operators import lifecycle as L

MEMORY = "id long, truth_key string, version int, created_at timestamp_ntz, status string, text string, confidence double, reward double, salience double"
DAY = datetime.datetime(2024, 1, 1)


def score(r):
    c = r[6] if r[6] > 0 else 1.0
    s = r[8] if r[8] > 0 else 1.0
    return round((0.55 * c + 0.25 * min(1, max(0, (r[7] + 1) / 2)) + 0.20 * min(1, max(0, s / 2))) * 1e9)


def replay(rows):
    """Adds each row and lets it meet all before it."""
    out = {r[0]: [r[4], None] for r in rows if r[1] and r[1].strip()}
    keys: dict[str, list] = {}
    for r in sorted((r for r in rows if r[1] and r[1].strip()), key=lambda r: (r[2], r[3], r[0])):
        if r[4] == "archived":
            continue
        key = r[1].strip().lower()
        for o in keys.setdefault(key, []):
            gap = score(r) - score(o)
            if r[2] > o[2] or r[5].strip().lower() == o[5].strip().lower() or gap >= L.GAP:
                out[o[0]][0] = "superseded"
                if r[2] > o[2]:
                    out[o[0]][1] = None
            elif gap > -L.GAP:
                out[o[0]] = ["conflicted", f"conflict:{key}"]
                out[r[0]] = ["conflicted", f"conflict:{key}"]
            else:
                out[r[0]][0] = "superseded"
        keys[key].append(r)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_conflicts(spark, seed):
    rng = random.Random(seed)
    rows = [
        (i, rng.choice(["k", "K ", "k2", "k3", "", None]), rng.choice([1, 1, 1, 2]), DAY + datetime.timedelta(hours=rng.randrange(30)), rng.choice(["active"] * 5 + ["archived"]), rng.choice(["a", "b ", "B", "c", f"t{i}"]), rng.choice([0.0, 0.2, 0.5, 0.9]), rng.choice([-1.0, 0.0, 0.4, 1.0]), rng.choice([0.0, 0.6, 2.0]))
        for i in range(150)
    ]
    got = {r.id: [r.new_status, r.conflict_group] for r in L.resolve_conflicts(spark.createDataFrame(rows, MEMORY)).collect()}
    want = replay(rows)
    assert {i: s for i, (s, _) in got.items()} == {i: s for i, (s, _) in want.items()}
    newest = {}
    for r in rows:
        if r[1] and r[1].strip() and r[4] != "archived":
            k = r[1].strip().lower()
            newest[k] = max(newest.get(k, 0), r[2])
    for r in rows:
        if r[0] in want and r[4] != "archived" and r[2] == newest[r[1].strip().lower()]:
            assert got[r[0]][1] == want[r[0]][1]


def greedy(nodes, links, least, most):
    near: dict[int, dict] = {}
    for a, b, s in links:
        if a != b and a in nodes and b in nodes:
            for x, y in ((a, b), (b, a)):
                near.setdefault(x, {})[y] = max(s, near.get(x, {}).get(y, -1))
    used, out = set(), []
    for i in sorted(nodes, key=lambda i: (-nodes[i][0], nodes[i][1], i)):
        if i in used:
            continue
        cluster = [i, *[b for b, s in sorted(near.get(i, {}).items(), key=lambda x: (-x[1], x[0])) if b not in used]][:most]
        if len(cluster) >= least:
            used.update(cluster)
            out += [(i, b) for b in cluster]
    return sorted(out)


@pytest.mark.parametrize(("least", "most", "seed", "mates"), [(2, 4, 1, 1), (3, 3, 2, 6), (1, 5, 3, 6), (1, 5, 3, 2000)])
def test_consolidation_is_the_greedy_one(spark, monkeypatch, least, most, seed, mates):
    """One giant component and small ones, finished in groups or taken apart in rounds."""
    monkeypatch.setattr(L, "MATES", mates)
    rng = random.Random(seed)
    nodes = {i: (rng.randrange(6), DAY + datetime.timedelta(hours=rng.randrange(9))) for i in range(70)}
    links = [(rng.randrange(72), rng.randrange(72), round(rng.random(), 1)) for _ in range(110)] + [(5, 5, 0.9)]
    df = spark.createDataFrame([(i, *v) for i, v in nodes.items()], "id long, access_count long, created_at timestamp_ntz")
    got = L.consolidate(df, spark.createDataFrame(links, "a long, b long, similarity double"), least, most)
    assert sorted((r.cluster, r.id) for r in got.collect()) == greedy(nodes, links, least, most)


def test_consolidation_of_nothing(spark):
    df = spark.createDataFrame([(1, 0, DAY)], "id long, access_count long, created_at timestamp_ntz")
    assert L.consolidate(df, spark.createDataFrame([], "a long, b long, similarity double"), 2, 4).count() == 0


def test_reinforcement_event_by_event(spark):
    rng = random.Random(4)
    events = [(rng.randrange(3), 9, rng.randrange(12), rng.uniform(-0.9, 0.9)) for _ in range(200)]
    want: dict[int, list] = {}
    for a, _, day, delta in sorted(events):
        w, at, n = want.get(a, (0.0, day, 0))
        want[a] = (max(-1.0, min(1.0, w * 0.9 ** (day - at) + delta)), day, n + 1)
    got = {r.a: (r.weight, r.activations) for r in L.reinforce(spark.createDataFrame(events, "a int, b int, at_day int, delta double"), 0.1, 1.0).collect()}
    assert {a: w for a, (w, _) in got.items()} == pytest.approx({a: v[0] for a, v in want.items()}) and {a: n for a, (_, n) in got.items()} == {a: v[2] for a, v in want.items()}


def test_first_rows_of_any_number(spark, monkeypatch):
    from recallbase.operators import shared

    monkeypatch.setattr(shared, "BUCKETS", 8)
    monkeypatch.setattr(shared, "SORTED", 10)
    rng = random.Random(6)
    rows = [(i, rng.choice([0.0, 1.5, 1.5, rng.random() * 100, -3.25])) for i in range(800)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, v double")
    want = [i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))]
    for n in (0, 1, 9, 150, 333, 500, 799, 800, 5000):
        got = shared.first_rows(df, n, "v", "id").collect()
        assert sorted(r.id for r in got) == sorted(want[:n]), n
    assert shared.first_rows(df.limit(0), 5, "v", "id").count() == 0
    assert shared.first_rows(spark.range(500).selectExpr("7L AS id", "1.0D AS v"), 120, "v", "id").count() == 120
    sized = spark.createDataFrame([(i, v, 1 + i % 7) for i, v in rows], "id long, v double, w long")
    for budget in (0, 1, 50, 1500, 2390, 9999):
        want, spent = set(), 0
        for i, _ in sorted(rows, key=lambda r: (r[1], r[0])):
            spent += 1 + i % 7
            if spent <= budget:
                want.add(i)
        assert {r.id for r in shared.first_rows(sized, budget, "v", "id", "w").collect()} == want


def test_folds_over_scores_at_least_as_high(spark, monkeypatch):
    """However scores fall into ranges; a key with most rows included."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(L, "RANGE", 7)
    rng = random.Random(8)
    points = [(rng.choice("aaaab"), rng.randrange(-20, 60), i) for i in range(400)]
    asked = [(k, at) for k in "abc" for at in range(-25, 70, 3)]
    p, q = spark.createDataFrame(points, "k string, score long, i long"), spark.createDataFrame(asked, "k string, at long")
    got = {(r.k, r.at): r.found for r in L.at_least(p, ["k"], q, F.count("*"), F.sum).collect()}
    most = {(r.k, r.at): r.found for r in L.at_least(p, ["k"], q, F.max("i"), F.max).collect()}
    for k, at in asked:
        high = [i for key, s, i in points if key == k and s >= at]
        assert (got.get((k, at)) or 0) == len(high) and most.get((k, at)) == max(high, default=None)


def test_a_key_with_half_of_all_rows(spark):
    """One key, one version: the same result as by the plain loop, and no window of a key's rows in the plan."""
    rng = random.Random(9)
    rows = [(i, "hot" if i % 2 else f"k{i}", 1, DAY + datetime.timedelta(minutes=rng.randrange(5000)), "active", rng.choice(["a", "b", f"t{i}"]), rng.random(), rng.uniform(-1, 1), rng.uniform(0.1, 2)) for i in range(700)]
    got = L.resolve_conflicts(spark.createDataFrame(rows, MEMORY))
    assert {r.id: r.new_status for r in got.collect()} == {i: s for i, (s, _) in replay(rows).items()}
