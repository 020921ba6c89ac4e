"""Spelling variants against brute force over deletion sets, whatever the size of the trees."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from recallbase.llm import spelling

LOWER = {a: a + 32 for a in range(ord("A"), ord("Z") + 1)}


def expected(rows, least=7, often=2, ratio=10, slip=31):
    """The rows that variants returns, from (doc_id, text)."""
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if slip and doc_id is not None and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += len(run) >= least
    n = {w: c for w, c in count.items() if c >= often}
    near = defaultdict(set)
    cuts = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            cuts[i, w[:i] + w[i + 1 :]].add(w)
    for (_, rest), ws in cuts.items():
        for a in ws:
            near[a] |= ws - {a}
            if rest in n:
                near[a].add(rest)
                near[rest].add(a)
    form = {w: best for w in n if near[w] and n[best := min(near[w], key=lambda x: (-n[x], x))] >= ratio * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


def found(docs, **options):
    rows = [tuple(r) for r in spelling.variants(docs, **options).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def edited(rng, word):
    i, letter = rng.randrange(len(word) + 1), rng.choice("abcdeéÉ")
    return rng.choice((word[:i] + letter + word[i:], word[:i] + word[i + 1 :], word[:i] + letter + word[i + 1 :]))


@pytest.fixture(scope="module")
def crowd():
    """Texts of words that crowd one beginning and one end, with runs of equal letters, and their edits once and twice removed."""
    rng = random.Random(5)
    stems = [a + "".join(rng.choices("ab", k=rng.randint(3, 9))) + b for a in ("", "aaaaaaaa", "prefix") for b in ("", "bbbbbb", "ending") for _ in range(12)]
    stems = [s if len(s) > 6 else s + "zzzzzzz" for s in stems]
    words = []
    for s in stems:
        words += [s] * rng.choice((2, 25, 300))
        for _ in range(6):
            e = edited(rng, s)
            words += [e] * rng.choice((1, 2, 20)) + [edited(rng, e)] * 2
    rng.shuffle(words)
    return [(i, " ".join(w.upper() if rng.random() < 0.1 else w for w in words[a : a + 97])) for i, a in enumerate(range(0, len(words), 97))]


@pytest.mark.parametrize("tree", [2, 10, 60, 50_000])
def test_equal_to_brute_force(spark, crowd, tree):
    docs = spark.createDataFrame(crowd, "doc_id long, text string").repartition(3)
    want = expected(crowd)
    assert len(want) > 300 and sum(r[1] is not None for r in want) > 30 and any(r[2] not in (r[0], r[1]) for r in want)
    assert found(docs, tree=tree) == want


@pytest.mark.parametrize("least", [2, 3, 4, 5])
def test_short_words(spark, least):
    rng = random.Random(least)
    rows = [(i, " ".join("".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(150))) for i in range(6)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), least=least, ratio=2, tree=20) == expected(rows, least=least, ratio=2)


def test_merged_finds_each_pair_once():
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("ab", k=rng.randint(1, 7))) for _ in range(150)})

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        return any(a == b[:i] + b[i + 1 :] for i in range(len(b))) if len(a) < len(b) else len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1

    got = [tuple(sorted(p)) for p in spelling.merged(words)]
    assert len(got) == len(set(got))
    assert set(got) == {(i, j) for j in range(len(words)) for i in range(j) if near(words[i], words[j])}


def test_awkward_rows(spark, odd, odd_rows, empty):
    long = [(90, "z" * 20_000 + " " + "z" * 20_001), (91, "z" * 20_000 + "  " + "z" * 20_001), (None, "Strasse-ÀÉÎÕÜßÿ×÷ ÀÉÎÕÜßÿ×÷"), (None, "ÀÉÎÕÜßÿ×÷")]
    docs = odd.select("doc_id", "text", "n", "lang").unionByName(spark.createDataFrame(long, "doc_id long, text string"), allowMissingColumns=True)
    rows = [(r[0], r[1]) for r in odd_rows] + long
    assert found(docs) == expected(rows)
    assert found(docs, slip=None, often=1) == expected(rows, slip=None, often=1)
    assert found(empty) == set()
    assert found(spark.createDataFrame([(1, None), (2, ""), (3, "short 123")], "doc_id long, text string")) == set()
