from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from recallbase.llm import toxicity as X

from .conftest import DOC, doc_row, words


def roc(scores, labels):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    pos = np.asarray(labels) == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_subwords_of_a_word_are_its_own_whatever_stands_beside():
    alone, n = X.subwords(["idiot"])
    both, m = X.subwords(["a", "idiot", "漢字x"])
    assert both[m[0] : m[0] + m[1]].tolist() == alone.tolist() and n[0] == m[1] == 5 + 4 + 3 + 1
    assert X.subwords([])[0].tolist() == []


def test_windows_cover_all_words():
    for n in range(1, 60):
        a, b = X.windows(n)
        assert set().union(*(range(x, y) for x, y in zip(a, b, strict=True))) == set(range(n)) and (b > a).all()


def test_misspellings_share_their_words_vectors():
    rng = random.Random(3)
    bad = ["blorgface", "zunkwit", "quabnose"]
    texts, labels = [], []
    for i in range(600):
        ws = words(rng, rng.randint(20, 120)).split()
        if i % 6 == 0:
            ws[rng.randrange(len(ws))] = rng.choice(bad)
        texts.append(" ".join(ws))
        labels.append(int(i % 6 == 0))
    model = X.train(texts, np.array(labels))
    table = lambda t: X.subwords(X.words_of(t))

    def score(t):
        sub, n = table(t)
        sums = np.add.reduceat(model.weight[sub], np.concatenate([[0], np.cumsum(n)[:-1]]))
        return float(model.score(X._worst(sums, n, [len(n)], model.bias)[0])[0])

    clean = [score(words(rng, 60)) for _ in range(40)]
    wrong = [score(words(rng, 30) + f" {w} " + words(rng, 30)) for w in ("blorgfacee", "bl0rgface", "zunkwitt", "quabnoze") for _ in range(5)]
    assert roc(wrong + clean, [1] * len(wrong) + [0] * len(clean)) > 0.9 and np.mean(np.array(clean) >= 0.7) < 0.1


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = X.predict(spark.read.parquet(f"{sf}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    toxic = np.array([r.toxic for r in rows])
    predicted = np.array([r.predicted for r in rows])
    # A tenth of the labels of this table is noise, and the table has few.
    assert roc([r.score for r in rows], toxic) > 0.88
    assert predicted[toxic == 1].mean() > 0.7 and predicted[toxic == 0].mean() < 0.05


def test_odd_rows_and_empty_tables(spark, odd, odd_rows, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int, score double")
    assert {(r.score, r.predicted) for r in X.predict(odd, none).collect()} == {(0.0, 0)}
    rng = random.Random(4)
    train = [doc_row(i, words(rng, 30) + (" blorgface" if i % 3 == 0 else "")) for i in range(1000, 1200)]
    labels = spark.createDataFrame([(r[0], 1, int(r[0] % 3 == 1)) for r in train] + [(None, None, None), (3, None, 1), (1001, 1, None), (5, 1, 7), (2, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    got = X.predict(odd.unionByName(spark.createDataFrame(train, DOC)), labels).collect()
    assert len(got) == len(odd_rows) + 200 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    empties = {r.score for r in got if r.doc_id in (3, 4, 5)}
    assert len(empties) == 1
    assert X.predict(empty, labels).count() == 0
    assert X.keep_clean(odd, labels).columns == odd.columns


def test_labels_without_words_give_no_model():
    assert X.train(["", " "], np.array([0, 1])) is None
    assert X.train(["hello world there", ""], np.array([0, 1])) is None
    assert X.train([], np.array([], np.int64)) is None


def plain_score(model, text):
    """The forward pass as it is described: for each window the mean of its subwords' weights, the worst through the curve."""
    ws = [w for i, w in enumerate(text.lower().split()) if i == 0 or w != text.lower().split()[i - 1]]
    best = None
    for at in range(0, max(1, len(ws) - X.WORDS // 2), X.WORDS // 2):
        weights = [model.weight[i] for w in ws[at : at + X.WORDS] for i in X.subwords([w])[0]]
        odds = model.bias + (sum(weights) / len(weights) if weights else 0.0)
        best = odds if best is None else max(best, odds)
    return 1 / (1 + np.exp(-(model.slope * best + model.shift)))


def test_scores_equal_a_plain_forward_pass(spark, odd, odd_rows):
    rng = random.Random(8)
    texts = [words(rng, rng.randint(1, 60)) + (" blorgface" if i % 4 == 0 else "") for i in range(300)]
    model = X.train(texts, np.array([int(i % 4 == 0) for i in range(300)]))
    rows = [*odd_rows, *(doc_row(1000 + i, t) for i, t in enumerate(texts[:40])), doc_row(2000, "blorgface " * 9 + texts[1])]
    got = {}
    for r in X.score(spark.createDataFrame(rows, DOC), model).collect():
        got.setdefault(r.doc_id, []).append(r.score)
    want = {}
    for r in rows:
        if len(r[1] or "") < 20_000:
            want.setdefault(r[0], []).append(plain_score(model, r[1] or ""))
    for k, scores in want.items():
        if len(scores) == len(got[k]):
            assert np.allclose(sorted(scores), sorted(got[k]), atol=1e-9)


def test_a_rare_label_is_sampled_for_itself(spark):
    """One toxic document in two thousand, and one label whose documents are all too long."""
    rng = random.Random(9)
    rows = [doc_row(3 * i, words(rng, 12) + (" blorgface zunkwit" if i % 2000 == 0 else "")) for i in range(6000)]
    docs = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame([(r[0], int("blorgface" in r[1])) for r in rows], "doc_id long, toxic int")
    drawn = {r.toxic: r.n for r in X.sample(docs, labels).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    outside = labels.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1) & (F.col("toxic") == 1)).count()
    assert drawn[1] == outside > 0 and drawn[0] == X.SAMPLE
    long = spark.createDataFrame([doc_row(0, "bad " * 20_000), doc_row(3, "good words"), doc_row(6, "other words")], DOC)
    one = spark.createDataFrame([(0, 1), (3, 0), (6, 0)], "doc_id long, toxic int")
    drawn = X.sample(long, one, held_fold=9).collect()
    assert sorted(r.toxic for r in drawn) == [0, 0, 1] and max(len(r.text) for r in drawn) == X.SAMPLE_CHARS
