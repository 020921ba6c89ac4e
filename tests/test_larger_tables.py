"""What only tables larger than the given ones bring about."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recallbase.functions import text as T
from recallbase.operators import lifecycle as L
from recallbase.operators import quantized as Q
from recallbase.operators import retrieval as H
from recallbase.operators import state as S
from recallbase.operators import textscan
from recallbase.operators import vectors as V
from recallbase.plans import load
from recallbase.sources import documents
from recallbase.streaming import heap, streams


def test_batch_whose_ids_are_taken(spark, sf_dir, tmp_path):
    """m02 gives what its SQL gives where ids lie 100,000 apart."""
    for name, key in (("embeddings", "vec_id"), ("documents", "doc_id"), ("events", "event_id")):
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet").where(F.col(key) < 20)
        rows.unionByName(rows.withColumn(key, F.col(key) + 100_000)).write.parquet(f"{tmp_path}/{name}.parquet")
    found = load().QUERIES["m02_batch_insert"](spark, str(tmp_path))
    got = sorted((r.id, r.version) for r in found.collect())
    held = [i + far for far in (0, 100_000) for i in range(20)]
    assert found.columns == ["id", "version"] and [i for i, _ in got] == sorted(held + [i + 100_000 for i in held])
    assert [v for i, v in got if i >= 200_000] == [1] * 20


def test_batch_by_several_keys(spark):
    rows = lambda *r: spark.createDataFrame(r, "batch int, id long")
    assert S.insert_all(rows((0, 1)), rows((1, 1)), "batch", "id").count() == 2
    for bad in (rows((0, 1), (1, 2)), rows((1, 2), (1, 2))):
        with pytest.raises(ValueError):
            S.insert_all(rows((0, 1)), bad, "batch", "id")


def test_similar_words_are_paired_once(spark):
    """A word that holds the term's beginning further in, while the term holds the word's."""
    words = lambda name, *w: spark.createDataFrame([(x,) for x in w], f"{name} string")
    found = H.similar_words(words("term", "abcdexyz", "erinnern"), words("token", "xyzabcdexyz", "abcdexyzabcde", "abcdexyz", "nernerinnern"))
    pairs = [(r.term, r.token) for r in found.collect()]
    assert sorted(pairs) == sorted([("abcdexyz", "xyzabcdexyz"), ("abcdexyz", "abcdexyzabcde"), ("abcdexyz", "abcdexyz"), ("erinnern", "nernerinnern")])


def test_candidates_beside_a_repeated_id(spark, monkeypatch):
    """The quantised search gives k others however often a query's own id stands among the rows, for any number of queries at once."""
    monkeypatch.setattr(Q, "TOLD", 3)
    model = Q.Codebooks(np.eye(2, dtype=np.float32), [np.array([[0.0], [0.5]], np.float32)] * 2)
    near, far = bytes([1, 0]), bytes([0, 0])
    rows = [(i, 0, near) for i in range(8) for _ in range(90)] + [(100, 0, far), (101, 1, near)]
    queries = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(8)], "query_id long, vector array<double>")
    found = Q.search_rows(spark.createDataFrame(rows[-2:] + rows[:90], "id long, cell int, codes binary"), model, queries.where("query_id = 0"), 1, 2)
    assert [(r.query_id, r.id, r.estimate, r["rank"]) for r in found.collect()] == [(0, 100, 1.0, 1)]
    found = Q.search_rows(spark.createDataFrame(rows, "id long, cell int, codes binary"), model, queries, 91, 2)
    assert sorted((r.query_id, r.id) for r in found.where("rank = 91").collect()) == [(0, 2)] + [(1, 2)] + [(i, 1) for i in range(2, 8)]


@pytest.mark.parametrize("k", [1, 3, 40])
def test_best_is_the_plain_choice(k):
    rng = np.random.default_rng(k)
    sim = np.round(rng.normal(size=(30, 25)), 1) + rng.choice([0, 2e-10, -2e-10], size=(30, 25))
    sim[rng.random(sim.shape) < 0.3] = -np.inf
    sim[0] = -np.inf
    who, best = V._best(sim, k)
    want = [(i, j) for i in range(30) for j in sorted(sorted(np.flatnonzero(np.isfinite(sim[i])), key=lambda j: (-np.round(sim[i, j], 9), j))[:k])]
    assert list(zip(who.tolist(), best.tolist(), strict=True)) == want


def test_few_similarities_at_once(spark, monkeypatch):
    """However few similarities a task holds at once, the neighbours are the same."""
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.integers(-2, 3, (60, 4)))], "id long, vector array<double>").repartition(3)
    asked = rows.where("id % 3 = 0").withColumnRenamed("id", "query_id")
    told = lambda: sorted((r.query_id, r.id, r["rank"]) for r in V.neighbours(asked, rows, 4).collect())
    want = told()
    monkeypatch.setattr(V, "CELLS", 7)
    assert told() == want


def test_tiering_takes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(n):
        seen.add(1)
        return n

    rows = spark.createDataFrame([(i, 10, i % 7) for i in range(50)], "id long, n long, day long").coalesce(1)
    rows = rows.select("id", F.udf(count, "long")("n").alias("bytes"), F.timestamp_seconds(F.col("day") * 86_400).alias("accessed_at"))
    cold = L.tiering(rows, 200, F.lit(1.0), 40).where("cold").count()
    assert cold == 30 and seen.value == 50


def test_few_files_at_once(spark, monkeypatch):
    monkeypatch.setattr(documents, "FILES", 2)
    rows = spark.range(7, numPartitions=1)
    sizes = documents.by_slices(rows, lambda part: pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int64())], names=["n"]), "n long")
    assert sorted(r.n for r in sizes.collect()) == [1, 2, 2, 2]
    files = spark.createDataFrame([(f"{i}.txt", bytearray(b"a  b")) for i in range(5)] + [("x.json", bytearray(b"{")), ("y.txt", None), (None, bytearray(b"z"))], "name string, content binary").coalesce(1)
    got = documents.texts(files).collect()
    assert [r.text for r in got] == ["a b"] * 5 + [None] * 3 and [r.error is None for r in got] == [True] * 5 + [False] * 3


def test_archives_of_odd_texts(spark, tmp_path):
    """Blanks of any kind, empty texts, markup and nulls are as the SQL has them."""
    import duckdb

    odd = ["a\u00a0\u00a0b", "a \u00a0 b", "\u3000a\u202f", "a\vb\v", "a\x1c\x1fb\x85c\x85", "\u2028a\u2029", "", "   ", "\n\t", "\u00a0", "a\0b", "a\r\n\r\n\nb \f", "</w:t> &amp; <w:p> &#160; &lt", "\ufeffa\u200b", "ok", None]
    texts = [(i, t, "src1", "de") for i, t in enumerate(odd)] + [(-7, "x", " a\n\n\n  b", "d  e\u00a0\t"), (51, "x", "", ""), (52, "x", None, "de"), (53, "x", "src1", None), (None, "x", "src1", "de"), (2**62, "", " ", "")]
    spark.createDataFrame(texts, "doc_id long, text string, source string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(load().ORACLES["s16_docx_texts"]).fetchall()
    got = [(r.doc_id, r.text) for r in load().QUERIES["s16_docx_texts"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert documents.tidy("\x85 a\v \u00a0b \u2003\n\n\n\n\tc\u00a0") == "a \u00a0b\n\nc"


def test_answers_of_a_queue_in_parts(spark, tmp_path, monkeypatch):
    """Commands of one micro-batch are answered in order, a few at a time."""
    monkeypatch.setattr(heap, "TOLD", 3)
    rows = [(1, i, ("offer", "offer", "take", "done")[i % 4], None if i % 4 == 2 else i % 5, i % 3) for i in range(40)]
    spark.createDataFrame(rows[::-1], "queue long, seq long, op string, item long, priority int").repartition(2).write.parquet(f"{tmp_path}/in")
    with streams.rocksdb(spark):
        got = streams.drain(heap.answers(streams.table_stream(spark, f"{tmp_path}/in"), limit=4), "heap").orderBy("seq").collect()
    held, pending, numbered, want = [], set(), 0, []
    for _, _, op, item, priority in rows:
        answer, item, numbered = heap.command(held, pending, numbered, op, item, priority, 4)
        want.append((answer, item, len(held)))
    assert [(r.answer, r.item, r.waiting) for r in got] == want


def test_titles_through_words_are_titles_by_pairs(spark):
    """Values equal those of comparing each pair; blank ones aren't there, titles without words are within every query."""
    texts = ["Zugang Passwort zurücksetzen", "die Drucker druckt nicht", "", None, "der die das", "Passwörter Zugänge", "Druckern im Netzwerk Netzwerke", "  ", "abcdexyz", "xyzabcdexyz ab"]
    q = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    d = spark.createDataFrame(list(enumerate(reversed(texts))), "id long, title string")
    told = lambda rows: sorted((r.query_id, r.id, round(r.value, 9)) for r in rows.collect() if r.value > 0)
    found = H.title_similarities(q, d)
    assert told(found) == told(q.crossJoin(d).select("query_id", "id", T.title_similarity(F.col("text"), F.col("title")).alias("value")))


def test_words_like_no_query_are_not_written(spark, monkeypatch):
    """Hybrid search writes down words of documents only where they are like a word of a query, however long the texts are."""
    written, cut = [], H.cut
    monkeypatch.setattr(H, "cut", lambda df, rows=None: written.append(cut(df, rows)) or written[-1])
    texts = ["drucker am netzwerk " + " ".join(f"xx{i}yy{j}" for j in range(500)) for i in range(6)]
    docs = spark.createDataFrame([(i, "Drucker", t, ["netz"], [0]) for i, t in enumerate(texts)], "id int, title string, text string, keywords array<string>, categories array<int>")
    asked = spark.createDataFrame([(0, "Drucker\nNetzwerk druckt")], "query_id int, text string")
    for most in (H.HASHED, 0):
        monkeypatch.setattr(H, "HASHED", most)
        assert H.hybrid_search(asked, docs, 9).count() == 6
    of_docs = [df for df in written if "id" in df.columns]
    assert of_docs and all(r.token in ("drucker", "netzwerk") for df in of_docs for r in df.select("token").distinct().collect())


def test_every_item_is_searched_for(spark, sf_dir):
    asked = {r.item_id for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id").collect()}
    got = [r.query_id for r in load().QUERIES["x01_hybrid_search"](spark, sf_dir).select("query_id").collect()]
    assert set(got) == asked and len(got) == 8 * len(asked)


def test_many_queries_are_scored_as_few(spark, monkeypatch):
    """A scan of the documents finds what joins of their words find, a few documents at a time, with names, phrases, categories, copies and empty texts."""
    rng, words = random.Random(3), ["Drucker", "Druckers", "Netzwerkdrucker", "Zugang", "Zugänge", "Passwort", "Passwörter", "VPN", "Tunnel", "die", "Störung", "Störungen", "Toner", "voll", "voller", "abc", "abcde"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, some(rng.randint(1, 4)), some(rng.choice([0, 3, 30, 500])), [some(2), None] if i % 3 else None, [i % 4, None]) for i in range(40)]
    docs += [(100 + i, *docs[i][1:]) for i in range(9)] + [(200, None, some(20), [], None), (201, "die der", some(5), ["Drucker"], [1]), (202, "  ", None, [" "], [9]), (None, some(3), some(9), [], [])]
    d = spark.createDataFrame(docs, "id int, title string, text string, keywords array<string>, categories array<int>").coalesce(1)
    q = spark.createDataFrame([("a", some(3) + "\n" + some(9)), ("b", "VPN Zugang"), ("c", "Passwort\n" + some(400)), ("d", "die"), ("e", None), ("f", docs[5][1])], "query_id string, text string")
    kinds = spark.createDataFrame([(0, "Drucker"), (1, "VPN Zugang"), (1, "Toner"), (9, "Störungen")], "category_id long, phrase string")
    told = lambda k: {(r.query_id, r.id): [r[p] for p in (*textscan.PARTS, "score", "rank")] for r in H.hybrid_search(q, d, k, kinds).collect()}
    joined = told(60)
    monkeypatch.setattr(H, "FEW", 0)
    scanned = told(60)
    assert joined.keys() == scanned.keys() and len({n for n, _ in joined}) >= 5
    assert all(joined[key][:-1] == pytest.approx(scanned[key][:-1]) for key in joined)
    monkeypatch.setattr(textscan, "CELLS", 60)
    by_rank = lambda n: sorted((-scanned[m, i][5], -scanned[m, i][1], i) for m, i in scanned if m == n)[:4]
    assert {(n, v[-1], i) for (n, i), v in told(4).items()} == {(n, at, x[2]) for n in {m for m, _ in scanned} for at, x in enumerate(by_rank(n), 1)}


def test_hashes_that_two_words_share_are_not_taken(spark, monkeypatch):
    real, asked = F.xxhash64, []
    monkeypatch.setattr(F, "xxhash64", lambda word, seed: asked.append(word) or (F.length(word) if len(asked) == 1 else real(word, seed)))
    words = spark.createDataFrame([(f"w{i}",) for i in range(20)], "token string")
    assert textscan.seed_of(words) == 1 and len(asked) == 2
    assert len(textscan.Keyed.of(np.zeros(0, np.int64), np.zeros(0)).find(np.array([1, 2]))[0]) == 0
