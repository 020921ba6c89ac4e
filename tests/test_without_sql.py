"""Registered queries that SQL can't express, held against plain code over the same tables, through the query itself."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from recallbase.plans import load, views
from recallbase.sources import documents

REGISTRY = load()
CHECKED = {"v23_vector_fingerprint", "c07_char_chunks", "s15_document_texts", "t01_queue_transitions", "w14_consolidation", "x01_hybrid_search", "v09_changed_index_search", "v13_codebooks", "v25_quantised_search", "v26_synthetic_vectors"}


def test_all_are_here():
    assert set(REGISTRY.QUERIES) - set(REGISTRY.ORACLES) == CHECKED


def rows(name, spark, sf_dir):
    return REGISTRY.QUERIES[name](spark, sf_dir).collect()


def read(spark, sf_dir, name, *columns):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns).collect()


def test_vector_fingerprints(spark, sf_dir):
    want = {r.vec_id: hashlib.sha256(np.array(r.embedding, "<f4").tobytes()).hexdigest()[:24] for r in read(spark, sf_dir, "embeddings", "vec_id", "embedding")}
    assert {r.vec_id: r.fingerprint for r in rows("v23_vector_fingerprint", spark, sf_dir)} == want


def test_char_chunks_hold_the_whole_texts(spark, sf_dir):
    got = defaultdict(dict)
    for r in rows("c07_char_chunks", spark, sf_dir):
        got[r.doc_id][r.chunk] = r.text
    for r in read(spark, sf_dir, "documents", "doc_id", "text"):
        text = documents.tidy(r.text or "")
        parts = [got[r.doc_id][i] for i in range(len(got[r.doc_id]))]
        assert all(0 < len(p) <= 600 for p in parts) and (parts[0] == text[: len(parts[0])] and text.endswith(parts[-1]) if text else not parts)
        ends = {0}
        for p in parts:  # each begins within the one before, or right behind it
            ends = {s + len(p) for at in ends for s in range(max(0, at - 75), at + 2) if text.startswith(p, s)}
        assert len(text) in ends


def test_document_texts(spark, sf_dir):
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.said, self.off = [], 0

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("script", "style")

        def handle_endtag(self, tag):
            self.off -= tag in ("script", "style")

        def handle_data(self, data):
            if not self.off:
                self.said.append(data)

    pages = {r.page_id: r.html for r in read(spark, sf_dir, "pages", "page_id", "html")}
    got = {r.name: r for r in rows("s15_document_texts", spark, sf_dir)}
    assert len(got) == len(pages)
    for i, html in pages.items():
        r = got[f"p{i}.{('html', 'txt', 'pdf')[i % 3]}"]
        if i % 3 == 0:
            parser = Words()
            parser.feed(html)
            assert r.text.split() == " ".join(parser.said).split() and r.error is None
        elif i % 3 == 1:
            assert r.text.split() == html.split()
        else:
            assert r.text is None and r.error == "unsupported: pdf"


def test_consolidation_is_the_greedy_loop(spark, sf_dir):
    nodes = {r.id: (-r.access_count, r.created_at, r.id) for r in views.memory(spark, sf_dir).where("status IN ('active', 'conflicted')").select("id", "access_count", "created_at").collect()}
    near = defaultdict(dict)
    for r in views.synapse(spark, sf_dir).collect():
        if r.a in nodes and r.b in nodes:
            near[r.a][r.b] = near[r.b][r.a] = r.weight
    used, want = set(), set()
    for seed in sorted(nodes, key=nodes.get):
        if seed not in used:
            taken = sorted((b for b in near[seed] if b not in used), key=lambda b: (-near[seed][b], b))[:5]
            if len(taken) + 1 >= 2:
                used |= {seed, *taken}
                want |= {(seed, x) for x in (seed, *taken)}
    assert {(r.cluster, r.id) for r in rows("w14_consolidation", spark, sf_dir)} == want and want


def test_quantised_recall(spark, sf_dir):
    (r,) = rows("v25_quantised_search", spark, sf_dir)
    assert r.recall >= 0.9


def test_codebooks_leave_no_more_than_a_plain_loop(spark, sf_dir):
    """The error of all vectors against k-means one row after the other from farthest seeds."""
    from tests.test_vectors import error, farthest, plain_kmeans

    got = rows("v13_codebooks", spark, sf_dir)
    x = np.array([r.embedding for r in read(spark, sf_dir, "embeddings", "embedding")], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    coarse = error(x, plain_kmeans(x, farthest(x, 16), 8))
    assert len(got) == len(x) and sum(r.coarse_error for r in got) <= 1.1 * coarse and sum(r.error for r in got) < 0.7 * sum(r.coarse_error for r in got)


def test_a_changed_index_answers_as_a_fresh_one(spark, sf_dir, tmp_path):
    from recallbase.operators import segments
    from recallbase.plans.state_queries import changed_index

    got = {(r.query_id, r.id): (r["rank"], round(r.similarity, 9)) for r in rows("v09_changed_index_search", spark, sf_dir)}
    e, index, model = changed_index(spark, sf_dir)
    q = e.where("id % 50 = 0").selectExpr("id AS query_id", "vector")
    now = segments.live(spark, index).cache()
    ask = lambda i: {(r.query_id, r.id): (r["rank"], round(r.similarity, 9)) for r in segments.search(spark, i, model, q, 10, 24).collect()}
    assert got == ask(segments.create(now.select("id", "vector"), model, f"{tmp_path}/fresh")) == ask(segments.compact(spark, index, f"{tmp_path}/compact"))
    at = {r.id: np.array(r.vector) for r in now.collect()}
    ids = np.array([i for i, v in at.items() if len(v) == 64])
    x = np.stack([at[i] / np.linalg.norm(at[i]) for i in ids])
    hits = total = 0
    for r in q.collect():
        v = np.array(r.vector, np.float64)
        s = x @ v / np.linalg.norm(v)
        edge = np.sort(s[ids != r.query_id])[-10]
        hits += sum(sim >= edge - 1e-8 for (query, _), (_, sim) in got.items() if query == r.query_id)
        total += 10
    assert hits >= 0.9 * total
    assert segments.apply(index, e.selectExpr("1 AS seq", "id", "vector"), model, "two") is index  # a batch counts once
    assert not segments.needs_compaction(spark, index, 0.9) and segments.needs_compaction(spark, index, 0.1)


def test_hybrid_ranks(spark, sf_dir):
    """Each query's ranks are gapless and its scores the weighted means of the parts that are there."""
    from recallbase.operators.retrieval import Weights

    w, by_query = Weights(), defaultdict(list)
    for r in rows("x01_hybrid_search", spark, sf_dir):
        parts = [(r.semantic, w.semantic, True), (r.title, w.title, True), (r.lexical, w.lexical, r.lexical > 0), (r.keyword, w.keyword, r.keyword > 0), (r.category, w.category, r.category > 0)]
        assert r.score == pytest.approx(sum(v * x for v, x, on in parts if on) / sum(x for _, x, on in parts if on))
        by_query[r.query_id].append((r["rank"], r.score))
    assert by_query
    for ranked in by_query.values():
        ranked.sort()
        assert [n for n, _ in ranked] == list(range(1, len(ranked) + 1)) and [s for _, s in ranked] == sorted((s for _, s in ranked), reverse=True)


def test_queue_states(spark, sf_dir):
    got = rows("t01_queue_transitions", spark, sf_dir)
    assert got and {r.job_id for r in got} == {r.user_id for r in read(spark, sf_dir, "events", "user_id")}


def test_synthetic_vectors_have_length_one(spark, sf_dir):
    got = rows("v26_synthetic_vectors", spark, sf_dir)
    assert len(got) == len(read(spark, sf_dir, "embeddings", "vec_id")) and np.allclose([np.linalg.norm(r.vector) for r in got], 1, atol=1e-5)
