"""Source ingest against the plain loop."""

from __future__ import annotations

import numpy as np
import pytest

from recallbase.operators.ingest import ingest

SCHEMA = "pos long, id long, vector array<double>, source string, allowed boolean, match long"


def plain(chunks, store, least):
    """One chunk after the other, each met by the store and by the new chunks before it."""
    held = [(i, np.array(v), {s}) for i, v, s in store]
    out = []
    for pos, i, v, source, allowed in sorted(chunks, key=lambda c: c[0]):
        if not allowed or v is None:
            out.append((pos, i, "skipped", None, None, False))
            continue
        v = np.array(v)
        near = []
        for j, w, sources in held:
            n = np.linalg.norm(v) * np.linalg.norm(w)
            if n and round(float(v @ w / n), 9) >= least:
                near.append((-round(float(v @ w / n), 9), j, sources))
        if near:
            s, j, sources = min(near, key=lambda x: x[:2])
            out.append((pos, i, "duplicate", j, -s, source not in sources))
            sources.add(source)
        else:
            held.append((i, v, {source}))
            out.append((pos, i, "new", None, None, False))
    return sorted(out)


@pytest.mark.parametrize("block", [3, 40, 4096])
def test_is_the_plain_loop(spark, block):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(25, 6))
    vector = lambda: (centres[rng.integers(25)] + 0.25 * rng.normal(size=6)).tolist()
    store = [(i, vector(), f"s{i % 3}") for i in range(15)]
    chunks = [(i * 2, 1000 + i, vector(), f"s{rng.integers(4)}", bool(rng.random() < 0.95)) for i in range(120)]
    chunks += [(1000 + i, 2000 + i, chunks[3][2], f"s{i % 5}", True) for i in range(60)]  # a third of all, one vector
    chunks += [(5000, 5000, None, "s1", True), (5001, 5001, [0.0] * 6, "s1", True), (5002, 5002, [0.0] * 6, "s2", None)]
    df = spark.createDataFrame([(*c, 7) for c in chunks], SCHEMA).repartition(4)
    there = spark.createDataFrame(store, "id long, vector array<double>, source string")
    got = sorted(((r.pos, r.id, r.outcome, r.match, r.similarity, r.corroborated) for r in ingest(df, there, 0.93, block).collect()))
    want = plain(chunks, store, 0.93)
    assert got == want
    assert {r[2] for r in want} == {"new", "duplicate", "skipped"} and any(r[3] is not None and r[3] >= 1000 for r in want) and any(r[3] is not None and r[3] < 1000 for r in want)


def test_nothing_to_ingest(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ingest(none, spark.createDataFrame([(1, [1.0], "s")], "id long, vector array<double>, source string")).count() == 0
    one = spark.createDataFrame([(1, 1, [1.0, 0.0], "s", True, 1)], SCHEMA)
    assert [r.outcome for r in ingest(one, spark.createDataFrame([], "id long, vector array<double>, source string")).collect()] == ["new"]


def test_many_new_chunks_take_one_round(spark, monkeypatch):
    """Chunks of short vectors are settled in larger blocks, each tile against those before it, and what is close to the threshold in double precision."""
    from recallbase.operators import ingest as I

    rng, rounds, settle = np.random.default_rng(9), [], I._settle
    monkeypatch.setattr(I, "_settle", lambda *a: rounds.append(1) or settle(*a))
    v = rng.normal(size=(5000, 64))
    turned = lambda x, c: c * x / np.linalg.norm(x) + (1 - c * c) ** 0.5 * np.roll(np.eye(64)[0], 5)
    v[:, 5] = 0.0
    near = [turned(v[i], c) for i, c in ((0, 0.93 - 2e-9), (1, 0.93 + 2e-9))]
    df = spark.createDataFrame([(i, i, x.tolist(), "s", True, 0) for i, x in enumerate([*v, *near])], SCHEMA).repartition(4)
    got = {r.pos: (r.outcome, r.match) for r in I.ingest(df, spark.createDataFrame([], "id long, vector array<double>, source string")).collect()}
    assert len(rounds) == 2 and all(got[i] == ("new", None) for i in range(5000))
    assert got[5000] == ("new", None) and got[5001] == ("duplicate", 1)
    units = np.stack([x / np.linalg.norm(x) for x in rng.normal(size=(8, 4))])[rng.integers(8, size=60)] + 0.2 * rng.normal(size=(60, 4))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    held: list[int] = []
    for i, x in enumerate(units):
        if not any(round(float(x @ units[j]), 9) >= 0.93 for j in held):
            held.append(i)
    assert I.first_of_each(units, 0.93, tile=7).tolist() == I.first_of_each(units, 0.93).tolist() == held
