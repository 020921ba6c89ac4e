"""Quality rules against plain loops: measures, sketches, fences, and the join of both."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from recallbase.llm import quality
from tests.llm.conftest import words

WORD = "[^\x20\x09-\x0d]+"


def plain_measures(text):
    text = text or ""
    w = re.findall(WORD, text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines)}


def cut_bits(v):
    s = max(0, v.bit_length() - quality.BITS)
    return v >> s << s


def plain_judge(rows, least=quality.LEAST, slack=quality.SLACK):
    """kept of every (lang, source, text), in turn."""
    measured, values = [], defaultdict(list)
    for lang, source, text in rows:
        m = plain_measures(text)
        failed = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
        rate = None if failed else {"word_size": 1000 * m["word_chars"] // m["n_words"], "symbols": 1000 * m["n_symbols"] // m["n_words"], "dup_lines": 1000 * m["n_dup_lines"] // m["n_lines"]}
        measured.append(rate)
        if rate:
            for level in ((lang, source), (lang,), ()):
                for c, v in rate.items():
                    values[level, c].append(cut_bits(v))

    def fence(level, c):
        v = sorted(values[level, c])
        q1, q3 = v[-(-len(v) // 4) - 1], v[-(-3 * len(v) // 4) - 1]
        step = quality.SPREADS * max(q3 - q1, slack[c])
        return q1 - step, q3 + step

    out = []
    for (lang, source, _), rate in zip(rows, measured, strict=True):
        good = rate is not None
        if rate:
            level = next(x for x in ((lang, source), (lang,), ()) if not x or len(values[x, "symbols"]) >= least)
            good = all(fence(level, c)[0] <= v <= fence(level, c)[1] for c, v in rate.items())
        out.append(good)
    return out


@pytest.fixture(scope="module")
def mixed():
    """Sources of their own character, with junk among them; one holds a third of the rows, many hold few."""
    rng, rows = random.Random(3), []
    for i in range(700):
        source = "hot" if i % 3 == 0 else None if i % 7 == 0 else f"src{rng.randint(0, 12)}"
        lang = rng.choice(("en", "en", "de", None))
        text = words(rng, rng.randint(30, 160))
        if source == "hot":  # sums and tables
            text = text.replace(" ", " | ")
        if rng.random() < 0.1:
            text = rng.choice((text.replace(" ", "### "), (text[:40] + "\n") * 6 + text, text.replace(" ", ""), "a b c " * 90, text.replace(" ", "\n\n") + "\n" + text.replace(" ", "\n")))
        rows.append((i, lang, source, text))
    return rows


@pytest.mark.parametrize("least", [1, 20, 200])
def test_equal_to_plain_loops(spark, mixed, least):
    docs = spark.createDataFrame(mixed, "doc_id long, lang string, source string, text string").repartition(5)
    got = {r.doc_id: r for r in quality.judge(docs, least=least).collect()}
    assert len(got) == len(mixed)
    for (doc_id, _, _, text), kept in zip(mixed, plain_judge([r[1:] for r in mixed], least), strict=True):
        assert {c: got[doc_id][c] for c in quality.COUNTS} == plain_measures(text)
        assert got[doc_id].kept == kept, doc_id
    if least == 20:
        assert 0 < sum(not r.kept and not r.base_failed for r in got.values()) < 100
        assert got[0].hi_symbols > 600 > min(r.hi_symbols for r in got.values())  # a source of tables allows them


def test_measures_of_odd_texts():
    rng = random.Random(4)
    texts = ["", " \n\t", "a", "a b", "a b c", "a a a a", "x y z\x0bx y z\x0cx", "\x1c \x85 \xa0 word s", "ä|ö ## <b>\n\nä|ö ## <b>\r\nä|ö ## <b>", "one two three\none two three", "\n".join(["l"] * 500)]
    texts += [" ".join(rng.choices("ab", k=rng.randint(0, 12))) for _ in range(200)] + [words(rng, 20_000)]
    got = quality.measured([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert {c: int(got[c][i]) for c in quality.COUNTS} == plain_measures(t), t[:80]
    assert all(len(v) == 0 for v in quality.measured([]).values())


def test_sketches_merge(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), int(10 ** rng.uniform(0, 9))) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(4)
    parts = quality.sketches(df, ["v"], ["g"])
    whole = quality.merge(parts, [])
    assert {(r.value, r.n) for r in whole.collect()} == {(r.value, r.n) for r in quality.sketches(df, ["v"], []).collect()} == set(Counter(cut_bits(v) for _, v in rows).items())
    for v in (r[1] for r in rows):
        assert 0 <= v - cut_bits(v) <= v / 2 ** (quality.BITS - 1)


def test_joined_hot_and_seldom_keys(spark):
    keys = [None if i % 3 == 0 else "hot" if i % 3 == 1 else f"k{i % 1500}" for i in range(6000)]
    rows = spark.createDataFrame(list(enumerate(keys)), "i long, k string")
    table = rows.groupBy("k").agg(F.count("*").alias("c"), F.min("i").alias("first"))
    got = sorted((r.i, r.k, r.first) for r in quality.joined(rows, table, ["k"], "c", 6000).collect())
    first = {}
    for i, k in enumerate(keys):
        first.setdefault(k, i)
    assert got == [(i, k, first[k]) for i, k in enumerate(keys)]


def test_awkward_rows(spark, odd, odd_rows, empty):
    got = Counter((r.doc_id, r.n_words, r.base_failed, r.kept) for r in quality.judge(odd, least=3).collect())
    kept = plain_judge([r[2:4] + (r[1],) for r in odd_rows], 3)
    want = Counter()
    for r, k in zip(odd_rows, kept, strict=True):
        m = plain_measures(r[1])
        want[r[0], m["n_words"], m["n_words"] < 50 or 2 * m["n_repeat_words"] > m["n_words"], k] += 1
    assert got == want
    held = quality.keep_good(odd, least=3)
    assert held.schema == odd.schema
    assert Counter(r.doc_id for r in held.collect()) == Counter(r[0] for r, k in zip(odd_rows, kept, strict=True) if k)
    assert quality.judge(empty).count() == 0


def test_labelled_junk_goes_and_the_rest_stays(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = quality.judge(docs).join(labels, "doc_id").collect()
    assert not [r for r in rows if r.quality == 0 and r.kept]
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
