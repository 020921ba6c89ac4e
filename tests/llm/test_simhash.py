from __future__ import annotations

import random
import re

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from recallbase.llm import simhash
from recallbase.llm.common import components

from .conftest import words


def naive(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 4]) for i in range(len(ws) - 3)] or [" ".join(ws)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, radius=4):
    """Smallest index reachable, by brute force."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_fingerprint_is_the_plain_one(text):
    assert simhash.fingerprint(text) == naive(text)


def test_fingerprint_of_long_texts_and_blanks(rng):
    for t in [None, "", "  \x0b\n", "A b", words(rng, 500), "same " * 40, "x\x1cy\x85z w v u t"]:
        assert simhash.fingerprint(t) == naive(t)


def test_tree_finds_what_a_scan_finds(rng):
    points = list({rng.getrandbits(64) for _ in range(50)})
    points += [p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for p in points]
    points = list(dict.fromkeys(points))
    tree = simhash.BKTree(points)
    for p in points[:20]:
        assert sorted(tree.search(p, 4)) == [i for i, q in enumerate(points) if (p ^ q).bit_count() <= 4]
    tree.remove(3)
    assert 3 not in tree.search(points[3], 4)


def test_components_reach_the_smallest_id(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 103), (103, 101), (7, 7), (300, 300)]
    random.Random(1).shuffle(chain)
    got = {r.id: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == got[103] == 100 and got[300] == 300
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near(rng, fp, bits):
    for b in rng.sample(range(64), bits):
        fp ^= 1 << b
    return fp


def test_links_over_small_trees_lose_none(spark, monkeypatch):
    """A large group, dealt into several trees, and chains that only few links hold together."""
    monkeypatch.setattr(simhash, "TREE", 16)
    rng = random.Random(3)
    heart = rng.getrandbits(64)
    fps = {near(rng, heart, rng.randint(0, 5)) for _ in range(150)} | {rng.getrandbits(64) for _ in range(60)}
    at = rng.getrandbits(64)
    for _ in range(25):
        at = near(rng, at, 4)
        fps.add(at)
    fps = sorted(fps, key=lambda x: x - (1 << 64) if x >> 63 else x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {r.fp: r.component for r in simhash.linked(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    want = classes(fps)
    for i, x in enumerate(signed):
        assert got.get(x, x) == signed[want[i]]


def test_near_duplicates_against_brute_force(spark, odd, odd_rows):
    got = sorted((r.doc_id if r.doc_id is not None else -99, r.fingerprint, r.component_id if r.component_id is not None else -99) for r in simhash.near_duplicates(odd).collect())
    fps = [naive(r[1]) for r in odd_rows]
    roots = classes(fps)
    least = {}
    for r, root in zip(odd_rows, roots, strict=True):
        if r[0] is not None:
            least[root] = min(least.get(root, r[0]), r[0])
    want = sorted((r[0] if r[0] is not None else -99, f"{f:016x}", least.get(root, -99)) for r, f, root in zip(odd_rows, fps, roots, strict=True))
    assert got == want


def test_empty_table(empty):
    assert simhash.near_duplicates(empty).count() == 0
