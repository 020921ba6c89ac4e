from __future__ import annotations

import random

from recallbase.llm import decontaminate as D

from .conftest import DOC, doc_row, words

ITEM = "item_id long, text string, score double, doc_id long"


def plain_alignment(item, part):
    """Smith-Waterman, cell by cell."""
    best, above = 0.0, [0.0] * (len(part) + 1)
    for w in item:
        row = [0.0]
        for j, p in enumerate(part):
            row.append(max(0.0, above[j] + (D.SAME if p == w else D.OTHER), above[j + 1] + D.GAP, row[j] + D.GAP))
        best, above = max(best, *row), row
    return best


def numbers(texts):
    import pyarrow as pa

    h, _ = D.hashed_words(pa.array(texts))
    return h


def test_alignment_is_smith_waterman():
    import numpy as np

    rng = random.Random(2)
    for _ in range(40):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 14))] for _ in range(2))
        assert D.align(np.array(a, np.uint64), np.array(b, np.uint64))[0] == plain_alignment(a, b)


def test_words_hash_alike_wherever_they_stand():
    one = numbers(["Ein Wort, ÜBER-alles 42"])
    two = numbers(["x", "ein  wort\nüber alles 42!", "y"])
    assert list(one) == list(two[1:-1]) and len(set(one.tolist())) == 5


def edited(rng, item):
    """The item with a fifth of its words changed, left out or doubled, never three in a row."""
    out = []
    for i, w in enumerate(item.split()):
        out += {0: ["changed"], 3: []}.get(i % 11, [w])
    return " ".join(out)


def test_finds_copies_and_leaves_others(spark):
    rng = random.Random(5)
    items = [words(rng, rng.randint(14, 60)) for _ in range(30)]
    docs = []
    for i in range(200):
        body = words(rng, 120).split()
        k = i % 30
        if i < 60:
            at = rng.randrange(len(body))
            body[at:at] = (items[k] if i < 30 else edited(rng, items[k])).split()
        docs.append(doc_row(i, " ".join(body)))
    bench = spark.createDataFrame([(k, t, 1.0, 2) for k, t in enumerate(items)], ITEM)
    df = spark.createDataFrame(docs, DOC).repartition(4)
    found = {(r.doc_id, r.item_id): r.score for r in D.contaminated(df, bench).collect()}
    assert set(found) == {(i, i % 30) for i in range(60)}
    assert all(found[i, i] == 1.0 for i in range(30))
    import numpy as np

    for (d, k), s in found.items():
        whole = plain_alignment(list(numbers([items[k]])), list(numbers([docs[d][1]])))
        assert np.isclose(s, whole / (D.SAME * len(items[k].split())))
    kept = D.clean(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == list(range(60, 200))


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rng = random.Random(6)
    items = [words(rng, 20) for _ in range(12)]
    bench = spark.createDataFrame([(k, t, 1.0, 2) for k, t in enumerate(items)], ITEM)
    df = spark.createDataFrame([doc_row(i, words(rng, 50) + " " + items[i % 12] + " " + words(rng, 9)) for i in range(24)], DOC)
    whole = sorted(map(tuple, D.contaminated(df, bench).collect()))
    monkeypatch.setattr(D, "BLOCK_WORDS", 50)
    assert sorted(map(tuple, D.contaminated(df, bench).collect())) == whole and len(whole) == 24


def test_odd_rows_and_empty_tables(spark, odd, odd_rows, empty):
    bench = spark.createDataFrame([(1, None, 1.0, 2), (2, "", 1.0, 2), (3, "two words", 1.0, 2), (4, " ".join(odd_rows[0][1].split()[10:40]), 1.0, 2), (4, " ".join(odd_rows[0][1].split()[10:40]), 1.0, 2)], ITEM)
    found = sorted((r.doc_id, r.item_id) for r in D.contaminated(odd, bench).collect())
    assert found == sorted([(i, 4) for i in (0, 0, 1, 2, 50)] * 2)
    assert D.contaminated(empty, bench).count() == 0 and D.contaminated(odd, bench.limit(0)).count() == 0
    assert D.clean(odd, bench).count() == len(odd_rows) - 5


def regular(item, step, put_in=False):
    """The item with every step-th word replaced, or a word put in after every step-th."""
    out = []
    for i, w in enumerate(item.split(), 1):
        out += ([w, f"new{i}"] if put_in else [f"new{i}"]) if i % step == 0 else [w]
    return " ".join(out)


def test_regular_edits_are_found_as_by_brute_force(spark):
    rng = random.Random(8)
    items = [words(rng, n) for n in (4, 5, 6, 8, 15, 20, 30, 60, 120)]
    texts = []
    for item in items:
        for edit in ((4, False), (5, False), (6, False), (2, True), (3, True), (1, True)):
            texts.append(f"{words(rng, 40)} {regular(item, *edit)} {words(rng, 30)}")
    texts += [f"{words(rng, 9)} {item} {words(rng, 9)}" for item in items[::2] for _ in range(2)]  # exact copies elsewhere make intact n-grams the commoner ones
    want = {}
    for d, t in enumerate(texts):
        for k, item in enumerate(items):
            share = plain_alignment(list(numbers([item])), list(numbers([t]))) / (D.SAME * len(item.split()))
            if share >= 0.6:
                want[d, k] = share
    df = spark.createDataFrame([doc_row(i, t) for i, t in enumerate(texts)], DOC)
    rows = D.contaminated(df, spark.createDataFrame([(k, t, 1.0, 2) for k, t in enumerate(items)], ITEM)).collect()
    assert {(r.doc_id, r.item_id): r.score for r in rows} == want
    assert all((6 * k + e, k) in want for k in range(4, 9) for e in range(5))
    for r in rows:
        part = numbers([texts[r.doc_id]])[r.first_word : r.end_word]
        assert plain_alignment(list(numbers([items[r.item_id]])), list(part)) / (D.SAME * len(items[r.item_id].split())) == r.score


def test_items_of_one_to_three_words_are_found(spark):
    items = ["Xylophon", "zwei Wörter", "three short words"]
    texts = ["a xylophon, here", "zwei wörter", "zwei andere wörter", "some THREE short words more", "three other words", "zwei", "short words", "nothing of it"]
    df = spark.createDataFrame([doc_row(i, t) for i, t in enumerate(texts)], DOC)
    bench = spark.createDataFrame([(k, t, 1.0, 2) for k, t in enumerate(items)], ITEM)
    found = {(r.doc_id, r.item_id): r.score for r in D.contaminated(df, bench).collect()}
    assert found == {(0, 0): 1.0, (1, 1): 1.0, (2, 1): 0.75, (3, 2): 1.0, (6, 2): 4 / 6}
    assert {r.doc_id for r in D.clean(df, bench).select("doc_id").collect()} == {4, 5, 7}
