"""Hybrid search and word similarity against plain code."""

from __future__ import annotations

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recallbase.functions import text as T
from recallbase.operators import retrieval as H


def token_list(s):
    return [t for t in re.split(r"[\W_]+", (s or "").lower()) if len(t) >= 3 and t not in T.STOPWORDS]


def stem(w):
    for s in T.SUFFIXES:
        if w.endswith(s) and len(w.encode()) - len(s.encode()) >= 5:
            return w[: len(w) - len(s)]
    return w


def similar(a, b):
    la, lb = len(a.encode()), len(b.encode())
    if a == b:
        return 1.0
    if la < 4 or lb < 4:
        return 0.0
    short, long = min(la, lb), max(la, lb)
    x, y = (a, b) if la <= lb else (b, a)
    if short >= 5 and x in y:
        return min(1.0, 0.75 + 0.25 * short / long)
    sa, sb = stem(a), stem(b)
    if sa == sb and len(sa.encode()) >= 5:
        return 0.95
    x, y = (sa, sb) if len(sa.encode()) <= len(sb.encode()) else (sb, sa)
    if len(x.encode()) >= 5 and x in y:
        return 0.90
    n = 0
    for p, q in zip(a.encode(), b.encode(), strict=False):
        if p != q:
            break
        n += 1
    return min(1.0, n / long) if n >= 5 and n / short >= 0.70 else 0.0


def cover(needle, hay):
    return min(1.0, sum(max(similar(n, h) for h in hay) for n in needle) / len(needle)) if needle and hay else 0.0


def f1(a, b):
    a, b = set(a), set(b)
    c = len(a & b)
    return 2 * (c / len(a)) * (c / len(b)) / (c / len(a) + c / len(b)) if c else 0.0


def chunks(text, words=160, over=30):
    ws, out, at = (text or "").split(), [], 0
    while ws:
        out.append(" ".join(ws[at : at + words]))
        if at + words >= len(ws):
            break
        at += words - over
    return out


def phrase(p, q):
    pn, qn = " ".join(token_list(p)), " ".join(token_list(q))
    return 0.0 if not pn or not qn else 1.0 if pn in qn else cover(token_list(p), set(token_list(q)))


def plain(query, doc, cats):
    head, _, body = query.strip().partition("\n")
    body = body.strip() or head
    _, title, text, keywords, ids = doc
    semantic = max((f1(token_list(a), token_list(b)) for a in chunks(body) for b in chunks(text)), default=0.0)
    hn, tn = " ".join(token_list(head)), " ".join(token_list(title))
    whole = f"{title} {text}"
    named = 1.0 if title.strip() and (hn == tn or hn in tn or tn in hn) else max(cover(token_list(head), set(token_list(title))), f1(token_list(head), token_list(title)))
    kw = max((phrase(k, query) for k in keywords if k.strip()), default=0.0)
    lex = max(f1(token_list(query), token_list(whole)), cover(token_list(query), set(token_list(whole))), cover(token_list(head), set(token_list(title))), kw)
    cat = max((phrase(p, query) for i, p in cats if i in ids), default=0.0)
    parts = [(semantic, 0.45, True), (named, 0.20, bool(title.strip())), (lex, 0.20, lex > 0), (kw, 0.075, kw > 0), (cat, 0.075, cat > 0)]
    w = sum(w for _, w, ok in parts if ok)
    return sum(v * w for v, w, ok in parts if ok) / w, named


WORDS = ["Drucker", "Druckers", "drucken", "Netzwerk", "Netzwerkdrucker", "VPN", "Verbindung", "Verbindungen", "Anmeldung", "anmelden", "Passwort", "Kennwort", "größe", "größer", "Störung", "Störungen", "toner", "Papier", "Zugang", "zugänge", "office", "offices"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([w.lower() for w in WORDS]), st.sampled_from([w.lower() for w in WORDS])), min_size=5, max_size=30))
def test_token_similarity(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.token_similarity(F.col("a"), F.col("b")).alias("s"))
    for r in df.collect():
        assert r.s == pytest.approx(similar(r.a, r.b))


def test_similar_words_lose_none(spark):
    rng = random.Random(2)
    vocabulary = sorted({w.lower() for w in WORDS} | {"".join(rng.choice("abcde") for _ in range(rng.randint(3, 9))) for _ in range(200)})
    df = spark.createDataFrame([(w,) for w in vocabulary], "token string")
    got = {(r.term, r.token): r.similarity for r in H.similar_words(df.withColumnRenamed("token", "term"), df).collect()}
    want = {(a, b): similar(a, b) for a in vocabulary for b in vocabulary if similar(a, b) > 0}
    assert got == pytest.approx(want)


def test_hybrid_search(spark):
    rng = random.Random(5)
    some = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    docs = [(i, some(rng.randint(0, 3)), some(rng.choice([0, 5, 40, 400])), [some(2)] if i % 3 else [], [i % 4]) for i in range(60)]
    queries = [(0, "Drucker druckt nicht\nSeit gestern Störung am Netzwerkdrucker, Toner voll"), (1, "VPN Zugang"), (2, "Passwort vergessen\n" + some(300))]
    cats = [(0, "Drucken"), (1, "VPN Verbindung"), (1, "Zugang"), (2, "Office Paket")]
    got: dict[int, list] = {}
    q, d, k = spark.createDataFrame(queries, "query_id int, text string"), spark.createDataFrame(docs, "id int, title string, text string, keywords array<string>, categories array<int>"), spark.createDataFrame(cats, "category_id int, phrase string")
    for r in H.hybrid_search(q, d, 10, k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    for i, text in queries:
        ranked = sorted(((*plain(text, doc, cats), doc[0]) for doc in docs), key=lambda x: (-round(x[0], 9), -round(x[1], 9), x[2]))
        ranked = [x for x in ranked if x[0] > 0][:10]
        assert [s for _, s in got[i]] == pytest.approx([x[0] for x in ranked])
        assert {d for d, _ in got[i]} == {x[2] for x in ranked} or len({round(x[0], 9) for x in ranked}) < len(ranked)
    hits = H.hybrid_search(q, d, 10, k).join(d.select("id", "categories"), "id")
    again = H.rerank(hits, spark.createDataFrame([(0, 1), (1, 1), (2, None)], "query_id int, category_id int")).where("query_id = 1")
    assert all(r.category == 1.0 for r in again.collect() if 1 in r.categories)


def test_context_relevance(spark):
    rows = [("Drucker im Büro", "drucker"), ("a", "b"), ("VPN-Tunnel down", "vpn-tunnel wartung"), ("x", ""), ("Netz netz netz", "Netz")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(T.context_relevance(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([1.0, 0.0, 0.5, 0.0, 1.0])


def test_chunks_reach_the_end_of_long_texts(spark):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (3150, 3151, 20_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    assert {r.id: r.c for r in df.select("id", T.chunk_words(F.col("text")).alias("c")).collect()} == {i: chunks(t) for i, t in enumerate(texts)}
    assert [len(r.c) for r in df.select(T.chunk_words(F.col("text"), most=24).alias("c")).collect()] == [24, 24, 24]
    docs = df.select("id", F.lit("").alias("title"), F.concat("text", F.lit(" netzwerkdrucker toner")).alias("text"), F.array().cast("array<string>").alias("keywords"), F.array(F.lit(0)).alias("categories"))
    hits = H.hybrid_search(spark.createDataFrame([(0, "netzwerkdrucker toner")], "query_id int, text string"), docs, 5).collect()
    assert len(hits) == 3 and all(r.semantic > 0 for r in hits)
