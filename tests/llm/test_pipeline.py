"""The pipeline's stages on a table with planted cases, and the registration of all queries."""

from __future__ import annotations

import random
import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from recallbase.llm import queries, simhash  # noqa: E402

from .conftest import words  # noqa: E402

SECRET = "password = hunter2hunter2"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    folder = tmp_path_factory.mktemp("corpus")
    bench = [(k, words(rng, 30)) for k in range(10)]
    docs, labels = [], []
    for i in range(400):
        t = words(rng, rng.randint(60, 200))
        if i % 8 == 0:
            t = words(rng, 40) + " blorgface zunkwit " + words(rng, 40)
        if i % 50 == 7:
            t += " " + bench[i // 50][1]
        if i % 50 == 9:
            t += f" {SECRET} end"
        docs.append([i, t])
        labels.append((i, 1, int(i % 8 == 0)))
    for i, j in ((400, 1), (401, 1), (402, 2)):
        docs.append([i, docs[j][1]])
    docs.append([None, None])
    docs.append([403, None])
    rows = [(i, t, "en", "src1", None if t is None else len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]
    kept, columns = {}, docs.columns
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, corpus).cache()
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in kept.items()}
    bad = {i for i in range(400) if i % 8 == 0}
    assert not bad & ids["toxicity"] and len(ids["toxicity"] - bad) >= 0.97 * (404 - len(bad))
    groups = {r.component_id for r in simhash.near_duplicates(kept["toxicity"]).collect() if r.doc_id is not None}
    assert ids["near_dedup"] - {None} == groups and not {400, 401, 402} & ids["near_dedup"]
    planted = {i for i in range(400) if i % 50 == 7}
    assert ids["near_dedup"] - ids["decontamination"] == planted & ids["near_dedup"] and planted & ids["near_dedup"]
    assert ids["secrets"] == ids["decontamination"]
    texts = {r.doc_id: r.text for r in kept["secrets"].collect()}
    assert not any(SECRET in (t or "") for t in texts.values()) and any("[secret]" in (t or "") for t in texts.values())
    before = {r.doc_id: r.text for r in kept["decontamination"].collect()}
    assert all(re.sub(re.escape(SECRET), "[secret]", before[i] or "") == (t or "") for i, t in texts.items())
    assert ids["packing"] == ids["secrets"]


def test_near_dedup_goes_by_rows(spark):
    rng = random.Random(5)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    rows = [(1, a), (5, a), (5, b), (7, c), (7, c), (None, a), (None, d), (None, d), (9, None), (8, ""), (None, None), (0, c + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "own") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _row string").repartition(3)
    left = pipeline.near_dedup_stage(spark, docs, "")
    assert left.schema == docs.schema
    got = [(r.doc_id, r.text) for r in left.collect()]
    linked = {r.doc_id for r in simhash.near_duplicates(docs).where("component_id = 0").collect()}  # whether c and its longer form are near
    want = [(1, a), (5, b), (None, d), (8, ""), (0, c + " more")] + ([] if 7 in linked else [(7, c)])
    assert sorted(got, key=str) == sorted(want, key=str)


def test_near_dedup_against_groups(spark):
    """Of each component exactly one row stays, whatever ids and texts repeat."""
    rng = random.Random(6)
    texts = [words(rng, 50) for _ in range(12)]
    texts += [t + " x" for t in texts[:4]] + [t.replace(" ", "  ", 3) for t in texts[:4]] + [None, ""]
    rows = [(rng.choice((None, *range(9))), rng.choice(texts), "en", "s", 1) for _ in range(250)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    left = [(r.doc_id, r.text) for r in simhash.one_of_each(docs).collect()]
    prints = sorted({simhash.fingerprint(t) for t in texts})
    group = {p: p for p in prints}
    for _ in prints:
        for p in prints:
            for q in prints:
                if (p ^ q).bit_count() <= 4:
                    group[p] = group[q] = min(group[p], group[q])
    of = {}
    for i, t, *_ in rows:
        of.setdefault(group[simhash.fingerprint(t)], []).append((i is None, i or 0, (i, t)))
    assert len(left) == len(of)
    for i, t in left:
        mates = of.pop(group[simhash.fingerprint(t)])
        assert (i is None, i or 0) == min(mates, key=lambda m: m[:2])[:2] and (i, t) in [m[2] for m in mates]


def test_run_gives_the_last_stage(spark, corpus):
    out = pipeline.run(spark, corpus)
    assert {"doc_id", "piece", "sequence_id", "offset", "ids_crc32"} <= set(out.columns) and out.count() > 300


def test_stages_take_an_empty_table(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, corpus)
        assert docs.count() == 0


def test_all_queries_and_the_pipeline_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert set(queries.QUERIES) | {"pipeline"} <= set(names) and set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_over_whole_tables(name, spark, sf_dir):
    from recallbase.llm.queries import QUERIES

    rows = QUERIES[name](spark, sf_dir).count()
    if name not in ("op1_decontaminate", "op5_packing", "op7_fixity", "op9_hnsw", "op11_negatives", "op12_spelling"):
        assert rows == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
