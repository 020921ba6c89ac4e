from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from recallbase.llm import langid as L

VOCAB = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def all_segmentations(raw):
    if not raw:
        yield []
    for k in range(1, len(raw) + 1):
        for rest in all_segmentations(raw[k:]):
            yield [raw[:k], *rest]


def brute(raw, pieces, prob):
    at = {p: i for i, p in enumerate(pieces)}
    return sum(np.prod([prob[at[p]] for p in seg], axis=0) for seg in all_segmentations(raw) if all(p in at for p in seg))


@pytest.fixture(scope="module")
def tiny():
    pieces = sorted({bytes([b]) for b in range(256)} | {b" a", b"ab", b"abc", b"bc", b"bca", b"ca", b" ab"})
    rng = np.random.default_rng(5)
    prob = rng.random((len(pieces) + 1, 3))
    prob[-1] = 0
    return pieces, L.PieceIndex(pieces), prob / prob.sum(0)


def test_forward_sums_all_segmentations(tiny):
    pieces, index, prob = tiny
    words = ["a", "abc", "abcabca", "zzz", "abab", "cab"]
    got = L.word_scores(words, index, prob)
    for w, row in zip(words, got, strict=True):
        assert np.allclose(row, np.log(brute(b" " + w.encode(), pieces, prob)))


def test_expected_counts_are_those_of_all_segmentations(tiny):
    pieces, index, prob = tiny
    at = {p: i for i, p in enumerate(pieces)}
    words, counts = ["abca", "bcab"], np.array([[2.0, 1, 0], [0, 3, 1]])
    want = np.zeros_like(prob)
    for w, n in zip(words, counts, strict=True):
        raw = b" " + w.encode()
        total = brute(raw, pieces, prob)
        for seg in all_segmentations(raw):
            if all(p in at for p in seg):
                share = np.prod([prob[at[p]] for p in seg], axis=0) / total
                for p in seg:
                    want[at[p]] += n * share
    assert np.allclose(L._expected(words, counts, index, prob), want)


def test_piece_index_finds_pieces_and_nothing_else():
    pieces = L.load_pieces(VOCAB)
    index = L.PieceIndex(pieces)
    rng = random.Random(1)
    some = rng.sample(pieces, 2000) + [bytes(rng.randrange(256) for _ in range(rng.randint(1, 6))) for _ in range(2000)]
    at = {p: i for i, p in enumerate(pieces)}
    assert index.longest == max(map(len, pieces)) > 6
    for p in some:
        assert index.starts(np.frombuffer(p, np.uint8)[None])[0, :, 0].tolist() == [at.get(p[: k + 1], len(pieces)) for k in range(min(len(p), index.longest))]


def test_long_words_are_summed_whole(tiny, monkeypatch):
    """Taken apart or not, in stretches or not, the sum is that of the whole word."""
    pieces, index, prob = tiny
    rng = random.Random(2)
    words = ["".join(rng.choice("abcz") for _ in range(n)) for n in (60, 300, 5000)] + ["ab" * 3000, "漢字かな" * 40]
    whole = []
    for w in words:
        raw = b" " + w.encode()
        whole.append(L._forward(index.starts(np.frombuffer(raw, np.uint8)[None]), prob)[-1, 0])
    assert np.allclose(L.word_scores(words, index, prob), whole)
    assert max(len(L._cuts(b" " + w.encode(), index)) for w in words) > 50 and len(L._cuts(b"abc" * 100, index)) == 1
    monkeypatch.setattr(L, "CELLS", 64)
    assert np.allclose(L.word_scores(words, index, prob), whole)


def test_letters_are_those_of_unicode(spark, odd):
    rows = spark.createDataFrame([(10_001, "² ½ ③ __ 12", "en"), (10_002, "漢", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in L.identify(rows.unionByName(odd.select("doc_id", "text", "lang")), VOCAB).collect()}
    assert got[10_001] == "und" and got[10_002] == "en"


def test_learns_from_repeated_ids_and_long_texts(spark):
    """Rows that share one id, rows that are all equal, and texts beyond the sample's length."""
    rng = random.Random(3)
    text = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    a, b = [i for i in range(100, 120) if zlib.crc32(str(i).encode()) % 4 != 2][:2]
    rows = [(a, text("abcde", 20), "x") for _ in range(3000)] + [(b, "same words here", "y")] * 3000 + [(i, text("vwxyz", 5000), "z") for i in range(40)]
    got = L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), VOCAB)
    seen = {(r.doc_id if r.doc_id in (a, b) else 0, r.lang_pred) for r in got.select("doc_id", "lang_pred").distinct().collect()}
    assert seen == {(a, "x"), (b, "y"), (0, "z")}


def test_training_raises_the_likelihood():
    counts = {"x": Counter({"hello": 9, "help": 4, "held": 2}), "y": Counter({"olleh": 7, "pleh": 3})}
    pieces = L.load_pieces(VOCAB)
    index = L.PieceIndex(pieces)
    words = sorted(set(counts["x"]) | set(counts["y"]))
    before = None
    for rounds in (1, 2, 4):
        m = L.train(counts, pieces, rounds)
        s = L.word_scores(words, index, m.prob)
        now = sum(counts["x"][w] * s[i, 0] + counts["y"][w] * s[i, 1] for i, w in enumerate(words))
        assert before is None or now > before
        before = now


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = L.identify(docs, VOCAB).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 150 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_odd_rows_and_empty_tables(odd, odd_rows, empty):
    got = L.identify(odd, VOCAB).collect()
    assert len(got) == len(odd_rows) and {r.lang_pred for r in got} == {"en", "und"}
    und = sorted((-99 if r.doc_id is None else r.doc_id) for r in got if r.lang_pred == "und")
    assert und == sorted([3, 4, 5, 10, -99]) and all(r.score == (0.0 if r.lang_pred == "und" else 1.0) for r in got)
    assert L.identify(empty, VOCAB).count() == 0
    assert {(r.lang_pred, r.score) for r in L.score(odd, None).collect()} == {("und", 0.0)}
