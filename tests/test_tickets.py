"""Ticket decisions, outcomes and drafts against written cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallbase.operators import drafts as D
from recallbase.operators import tickets as K

HIT = "ticket_id int, id int, source string, score double, categories array<bigint>, approved boolean, rank string"


def test_candidates_and_their_reasons(spark):
    rows = [(1, i, "kb", s, [], True, "x") for i, s in enumerate((0.9, 0.85, 0.85, 0.84, 0.6, 0.1))] + [(2, 1, "KB ", 0.2, [], True, "x"), (3, 1, "other", 0.9, [], True, "x"), (4, 1, None, 0.9, [], True, "x")]
    s = K.Settings(most=3, floor=0.3, gap=0.2, sources=("kb",))
    got = {(r.ticket_id, r.id): (r["rank"], r.reason) for r in K.candidates(spark.createDataFrame(rows, HIT), s).collect()}
    assert [got[1, i] for i in range(6)] == [(1, "sent_to_ai"), (2, "sent_to_ai"), (3, "sent_to_ai"), (4, "max_candidates_reached"), (5, "outside_candidate_gap"), (6, "below_retrieval_floor")]
    assert got[2, 1] == (1, "below_retrieval_floor") and not {(3, 1), (4, 1)} & set(got)
    assert K.candidates(spark.createDataFrame([], HIT), s).count() == 0


def test_a_ticket_from_hits_to_reply(spark):
    tickets = spark.createDataFrame([(i, True, 1, [1, 2]) for i in range(1, 7)] + [(7, None, None, None)], "ticket_id int, open boolean, category_id bigint, known_categories array<bigint>")
    hits = spark.createDataFrame([(i, 10 * i, "kb", 0.9, [2], True, "x") for i in range(1, 6)], HIT)
    answers = spark.createDataFrame([(1, 2, 0.9, 10, True, 0.9), (2, 9, 0.9, 20, True, 0.9), (3, 2, 0.1, 30, True, 0.9), (4, 2, 0.9, 99, True, 0.9), (6, 2, 0.9, 60, True, 0.9)], "ticket_id int, category_id bigint, category_confidence double, reply_id int, reply_allowed boolean, reply_confidence double")
    got = {r.ticket_id: r for r in K.process(tickets, hits, answers, K.Settings()).collect()}
    assert (got[1].category_decision, got[1].new_category, got[1].reply_decision, got[1].reply_id) == ("category_accepted", 2, "reply_accepted", 10) and got[1].evidence > 0.8
    assert (got[2].category_decision, got[2].reply_decision) == ("category_unknown", "reply_category_mismatch")
    assert (got[3].category_decision, got[3].reply_decision, got[3].reply_id) == ("category_confidence_below_threshold", "reply_category_mismatch", None)
    assert got[4].reply_decision == "reply_knowledge_not_found" and got[5].reply_decision == got[5].category_decision == "model_answer_missing"
    assert got[6].reply_decision == "reply_no_knowledge_candidates" and got[7].reply_decision == "ticket_not_open"


def test_outcomes_are_checked_and_repeats_known(spark):
    runs = spark.createDataFrame([(1, "v", "v", "<p>Do it</p>", "in", 0, 5, 6, " ", "kb"), (2, "v", "w", "x", "in", 1, 1, 1, None, None), (3, None, "w", " ", "in", 1, 1, 1, None, None)], "run_id int, source_version string, fresh_version string, proposed string, input string, basis_category int, ai_category int, category_before int, ai_knowledge string, knowledge string")
    said = [(1, 1, 1, "ACCEPTED ", None, None), (2, 1, 2, "accepted", None, "ann"), (3, 1, 3, "corrected", "Better", "ann"), (4, 1, 4, "corrected", "Better", "ann"), (5, 1, 5, "accepted", None, "ann"), (6, 2, 1, "accepted", None, "ann"), (7, 3, 1, "accepted", None, "ann"), (8, 9, 1, "accepted", None, "ann"), (9, 1, 9, None, None, None), (10, 1, 9, "corrected", " ", None)]
    got = {r.id: r for r in K.record_outcomes(runs, spark.createDataFrame(said, "id int, run_id int, at int, decision string, corrected string, actor string")).collect()}
    assert [got[i].state for i in range(1, 11)] == ["recorded", "repeated", "recorded", "repeated", "recorded", "ticket_changed", "no_reply_proposal", "run_not_found", "unknown_decision", "correction_without_text"]
    assert (got[1].confirmed, got[1].category_id, got[1].knowledge_id, got[1].actor, got[1].supersedes) == ("Do it", 5, "kb", "technician", None)
    assert got[3].supersedes == 1 and got[5].supersedes == 3 and got[4].supersedes is None


def test_mapping_is_refused_or_folded(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "label string, ids array<bigint>")
    got = K.save_mapping(rows((" Net  work", [3, 1]), ("NET WORK", [1, 7]), ("gone", []))).collect()
    assert [tuple(r) for r in got] == [("net work", "NET WORK", [1, 3, 7])]
    for bad in ((" ", [1]), ("x", [0]), (None, [1])):
        with pytest.raises(ValueError):
            K.save_mapping(rows(bad))


def test_strict_json(spark):
    cases = {'{"a":1}': None, '{"A":1}': None, '{"a":{"z":[1]}}': None, '{"a":1} {"a":2}': "multiple_values", '{"a":1}} x': "multiple_values", '{"a":1}, "end": 2': "multiple_values", '"a"': "not_an_object", "7": "not_an_object", "{": "invalid", " ": "invalid", '{"b":1}': "unknown_field"}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "raw string")
    got = {r.raw: r.x.error for r in df.select("raw", D.strict_object(F.col("raw"), ["a"]).alias("x")).collect()}
    assert got == cases | {None: "invalid"}


def test_embedding_batches_are_bounded(spark):
    sizes = []
    rows = spark.createDataFrame([(i, None if i == 5 else "x" * i) for i in range(150)], "id long, text string").coalesce(1)
    got = D.embedded(rows, lambda texts: [[float(len(t)), float(len(texts))] for t in texts], batch=64).collect()
    sizes = [r.vector[1] for r in got]
    assert {r.id: r.vector[0] for r in got} == {i: float(0 if i == 5 else i) for i in range(150)} and max(sizes) == 64
    with pytest.raises(Exception, match="texts gave"):
        D.embedded(rows, lambda texts: []).collect()


def test_synthetic_vectors(spark):
    mask = (1 << 64) - 1
    for r in D.synthetic_vectors(spark, 20, 6).collect():
        x, want = ((r.id + 1) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & mask, []
        for _ in range(6):
            x ^= x >> 12
            x ^= (x << 25) & mask
            x ^= x >> 27
            y = (x * 2685821657736338717 & mask) >> 32
            want.append((y - (1 << 32) if y >> 31 else y) / (2**31 - 1))
        assert np.allclose(r.vector, np.array(want) / np.linalg.norm(want), atol=1e-6)
