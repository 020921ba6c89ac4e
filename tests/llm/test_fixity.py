from __future__ import annotations

import hashlib
import random
import uuid

from recallbase.llm import fixity

PAGE = "page_id long, url string, html string, size long, digest string, node long"


def page(i, html="<p>x</p>", url="http://a/"):
    return (i, url, html, 1, "d", 2)


def record(r):
    body, url = (r[2] or "").encode(), (r[1] or "").encode()
    name = str(uuid.UUID(hashlib.md5(url + b"\n" + body).hexdigest())).encode()
    return b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:" + name + b">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: " + url + b"\r\nContent-Type: text/html\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_offsets_and_digests(spark):
    rng = random.Random(1)
    rows = [page(i, "é" * rng.randrange(50)) for i in range(0, 5000, 7)]
    got = fixity.records(spark.createDataFrame(rows, PAGE)).collect()
    files: dict[int, int] = {}
    for r in sorted(got, key=lambda r: (r.file, r.record)):
        raw = record(page(r.page_id, next(x[2] for x in rows if x[0] == r.page_id)))
        assert (r.file, r.start, r.length, r.digest) == (r.page_id // 1024, files.get(r.file, 0), len(raw), hashlib.sha256(raw).hexdigest())
        files[r.file] = r.start + r.length


def audited(spark, a, b):
    found = fixity.audit(fixity.records(spark.createDataFrame(a, PAGE)), fixity.records(spark.createDataFrame(b, PAGE)))
    return {(r.page_id, r.status) for r in found.collect()}


def test_finds_every_damage_and_nothing_else(spark):
    rng = random.Random(2)
    a = [page(i, f"<p>{rng.random()}</p>") for i in range(4000)]
    b = list(a)
    hit = rng.sample(range(4000), 9)
    for i in hit:
        b[i] = page(i, "damaged")
    assert audited(spark, a, b) == {(i, "changed") for i in hit}
    assert audited(spark, a, a) == set()
    assert audited(spark, a, a[:-3]) == {(i, "missing") for i in (3997, 3998, 3999)}
    assert audited(spark, a[:-2], a) == {(i, "extra") for i in (3998, 3999)}


def test_only_differing_branches_are_descended(spark):
    a = [page(i, str(i)) for i in range(40_000)]
    one = fixity.records(spark.createDataFrame(a, PAGE))
    b = list(a)
    b[20_000] = page(20_000, "other")
    two = fixity.records(spark.createDataFrame(b, PAGE))
    t1, t2 = fixity.Tree(one, 3, 2), fixity.Tree(two, 3, 2)
    bad = fixity._differing(t1.files[1], t2.files[1], "node")
    assert bad.count() == 1
    children = fixity._children(t1.files[0], bad)
    assert 0 < children.count() <= fixity.FAN


def test_odd_rows_and_empty_tables(spark):
    odd = [page(None), page(None, None, None), page(1, None), page(1, None), page(2, ""), page(2, "x", None), page(5, "y" * 300_000), page(-3, "z")]
    empty: list = []
    assert audited(spark, odd, odd) == set() and audited(spark, empty, empty) == set()
    assert {s for _, s in audited(spark, odd, empty)} == {"missing"} and {s for _, s in audited(spark, empty, odd)} == {"extra"}
    got = fixity.manifest(fixity.records(spark.createDataFrame(odd, PAGE)), fixity.records(spark.createDataFrame(odd[:4], PAGE))).collect()
    assert len(got) == len(odd) and sum(r.status == "ok" for r in got) == 4
    assert fixity.manifest(fixity.records(spark.createDataFrame(empty, PAGE)), fixity.records(spark.createDataFrame(empty, PAGE))).count() == 0


def test_against_sql(spark, sf_dir, same):
    from recallbase.llm import queries

    same(queries.op7_fixity(spark, sf_dir), queries.ORACLES["op7_fixity"])
