"""Sources, sinks and streams in cases that the queries over the driver's tables don't have."""

from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from recallbase.functions import text as T
from recallbase.operators import rules as R
from recallbase.operators import state as S
from recallbase.plans.stream_queries import commands
from recallbase.session import table
from recallbase.sources import articles, documents, logs, monitoring, sinks
from recallbase.streaming import queue, streams


def test_html_text_column_and_parser_agree(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    got = pages.select("html", T.html_to_text(F.col("html")).alias("text")).collect()
    assert all(" ".join(r.text.split()) == " ".join(documents.html_text(r.html).split()) for r in got)


def test_document_kinds(spark, tmp_path):
    body = '<w:p><w:r><w:t xml:space="preserve">Hello &amp; </w:t></w:r><w:r><w:tab/><w:t>you</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f"<w:document><w:body>{body}</w:body></w:document>")
    files = {"a.docx": buffer.getvalue(), "b.html": b"<p>x<br>y</p><script>no</script>z", "c.json": b'{"a": [1]}', "d.json": b"{", "e.pdf": b"%PDF", "f.txt": "ä  b\n\n\n\nc".encode(), "g.docx": b"no zip"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.name: r for r in documents.texts(documents.read_files(spark, str(tmp_path))).collect()}
    assert got["a.docx"].text == "Hello & you\n\ntwo" and got["b.html"].text == "x\ny\n\nz" and json.loads(got["c.json"].text) == {"a": [1]}
    assert got["f.txt"].text == "ä b\n\nc" and all(got[n].error and got[n].text is None for n in ("d.json", "e.pdf", "g.docx"))


def test_char_chunks():
    text = " ".join(f"word{i}." for i in range(900))
    pieces = documents.char_chunks(text, 200, 30)
    assert all(0 < len(p) <= 200 for p in pieces) and pieces[0].startswith("word0.") and pieces[-1].endswith("word899.")
    assert all(p.rsplit(" ", 1)[-1].rstrip(".") in text for p in pieces)
    for a, b in zip(pieces, pieces[1:], strict=False):
        assert a.split()[-1] in b or b.split()[0] in a or set(a.split()) & set(b.split())
    assert documents.char_chunks(None) == [] and documents.char_chunks(" \n ") == [] and len(documents.char_chunks("a" * 10_000, 100, 0, 7)) == 7


def test_article_scan_whole_files_and_modes(spark, tmp_path):
    made = {"a/x.json": {"id": "1", "title": "t", "source": "S1", "categories": ["Foo"], "auto_reply": True}, "y.tmp.json": {"id": "2", "title": "t", "source": "s1"}, "z.json": {"id": "", "title": "t", "source": "s1"}, "w.json": {"id": "4", "title": "t", "source": "s2"}, "v.json": {"id": "5", "title": "t", "source": "s1", "auto_reply": True, "categories": 3}}
    for name, doc in made.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(doc, indent=2))
    (tmp_path / "broken.json").write_text("{")
    rows = articles.scan(spark, str(tmp_path), per_file=True)
    mapping = articles.category_map(F.lit('{"bar": 3}'))
    got = {r.id: r for r in articles.decode(rows, ["s1"], mapping, ignore=["*.tmp.json"]).collect()}
    assert set(got) == {"1", "5"} and not got["1"].auto_reply and got["1"].unmapped_labels == ["Foo"] and got["5"].auto_reply and got["5"].categories == [3]
    assert {r.id for r in articles.decode(rows, ["s1"], mapping, mode="skip", ignore=["*.tmp.json"]).collect()} == {"5"}


@pytest.mark.parametrize(("glob", "hits"), [("*.json", ["a.json", "b/c.json"]), ("b/*.json", ["b/c.json"]), ("?.json", ["a.json", "b/c.json"]), ("[ab].json", ["a.json"]), ("x+.json", [])])
def test_globs(spark, glob, hits):
    df = spark.createDataFrame([("a.json",), ("b/c.json",), ("b/d.txt",)], "p string")
    assert [r.p for r in df.where(articles.ignored(F.col("p"), [glob])).collect()] == hits


def test_logs_with_nothing_sound(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.jsonl").write_text("\n{\nnull\n{\"a\": 1}\n" + json.dumps({"a": 2, "b": "x" * 2_000_000}) + "\n")
    rows = logs.read_jsonl(spark, str(tmp_path / "l"), "a int, b string")
    assert sorted(r.a for r in logs.sound(rows).where("a is not null").collect()) == [1, 2]


def test_labels_and_exposition_round_trip(spark):
    odd = {"a": 'q"u,o}t{e\\', "b": "line\nbreak", "c": ""}
    df = spark.createDataFrame([("m", odd, 3.0), ("n", {}, 1.0)], "metric string, labels map<string,string>, value double").select(sinks.exposition(spark.createDataFrame([("m", odd, 3.0)], "metric string, labels map<string,string>, value double")).alias("line"))
    assert df.first().line.endswith("} 3.0")
    back = df.select(monitoring.labels(F.col("line")).alias("l")).first().l
    assert back == odd


def test_queue_stream_is_the_plain_loop(spark, sf_dir):
    from recallbase.plans import load

    got = {(r.job_id, r.seq): (r.op, r.accepted, r.status, r.attempts) for r in load().QUERIES["t01_queue_transitions"](spark, sf_dir).collect()}
    state: dict[int, tuple] = {}
    rows = commands(table(spark, sf_dir, "events")).orderBy("seq").collect()
    for r in rows:
        ok, state[r.job_id] = queue.step(state.get(r.job_id, ("", None, 0.0, 0, 0.0)), r.op, r.worker, r["at"], 7200.0, 600.0, 3)
        assert got[r.job_id, r.seq] == (r.op, ok, state[r.job_id][0], state[r.job_id][3])
    assert len(got) == len(rows) and any(g[1] for g in got.values())


def test_queue_steps():
    new = ("", None, 0.0, 0, 0.0)
    ok, s = queue.step(new, "enqueue", None, 0, 10, 5, 2)
    assert ok and s[0] == "queued" and not queue.step(s, "enqueue", None, 1, 10, 5, 2)[0]
    _, s = queue.step(s, "claim", "w", 1, 10, 5, 2)
    assert s[:4] == ("claimed", "w", 11, 1)
    assert not queue.step(s, "done", "other", 2, 10, 5, 2)[0]
    late, after = queue.step(s, "done", "w", 11, 10, 5, 2)
    assert not late and after[0] == "queued"
    assert queue.step(s, "heartbeat", "w", 3, 10, 5, 2)[1][2] == 11 and queue.step(s, "heartbeat", "w", 7, 10, 5, 2)[1][2] == 17
    _, s = queue.step(s, "error", "w", 2, 10, 5, 2)
    assert s[0] == "retry_wait" and s[4] == 7 and not queue.step(s, "claim", "w", 6, 10, 5, 2)[0]
    _, s = queue.step(s, "claim", "w", 7, 10, 5, 2)
    assert queue.step(s, "error", "w", 8, 10, 5, 2)[1][0] == "failed" and queue.step(s, "x", None, 17, 10, 5, 2)[1][0] == "failed"
    assert queue.backoff(15, 9) == 960 and queue.backoff(600, 7) == 3600


def test_batches_run_again_leave_no_double_rows(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    stream = lambda: streams.table_stream(spark, str(tmp_path / "in"))
    streams.append_batches(stream(), str(tmp_path / "out"))
    spark.range(10, 15).write.mode("append").parquet(str(tmp_path / "in"))
    streams.append_batches(stream(), str(tmp_path / "out"))
    streams.append_batches(stream(), str(tmp_path / "out"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out" / "rows")).collect()) == list(range(15))


def test_state_refusals(spark):
    old = spark.createDataFrame([(1, "a")], "id long, v string")
    for ids in ([1], [2, 2]):
        with pytest.raises(ValueError):
            S.insert_all(old, spark.createDataFrame([(i, "b") for i in ids], "id long, v string"))
    jobs = spark.createDataFrame([(1, 3, [5, 6])], "id long, version int, candidates array<long>")
    results = spark.createDataFrame([(1, 2, [5]), (1, 3, [7]), (1, 3, [6, 5]), (9, 3, [5])], "id long, version int, neighbours array<long>")
    assert [r.outcome for r in S.apply_results(jobs, results).orderBy("id", "version", F.size("neighbours")).collect()] == ["stale", "foreign_neighbour", "applied", "unknown_job"]


def test_relations(spark):
    raw = json.dumps({"related": ["a", " A", "", {"name": "B", "kind": "sees"}, {"items_id": "7", "itemtype": "Item"}, {}], "links": "l", "other": "no"})
    got = [(r.kind, r.item_type, r.id, r.title) for r in spark.createDataFrame([(raw,)], "r string").select(F.explode(S.relations(F.col("r"))).alias("x")).select("x.*").collect()]
    assert got == [("related", None, "a", "a"), ("sees", None, "B", "B"), ("related", "Item", "7", "Item #7"), ("links", None, "l", "l")]


def test_small_text_columns(spark):
    one = lambda col: spark.range(1).select(col.alias("x")).first().x
    assert json.loads(one(T.repair_escapes(F.lit('{"a": "C:\\temp\\q \\\\ \\u00e4 \\x"}')))) == {"a": "C:\temp\\q \\ ä \\x"}
    assert one(T.useful_tokens(F.lit('Fehler 0x80 (Fehler) "drucker" der die 0xAB, netzwerk office extra mehr'))) == ["0x80", "0xAB", "Fehler", "drucker", "netzwerk"]
    got = one(T.research_queries(F.lit("FortiClient VPN"), F.lit("Erstelle einen Artikel zu forti-client Split-Tunnel, Zertifikate und Timeout sowie MTU"), F.lit("docs.example.org"), 4))
    assert got == ["FortiClient VPN", "FortiClient VPN site:docs.example.org", "FortiClient VPN Artikel Split-Tunnel Zertifikate Timeout"]
    assert one(T.research_queries(F.lit(""), F.lit("und zu"), F.lit(None).cast("string"), 4)) == ["und zu"]
    assert one(T.distinct_folded(F.array(F.lit(" A"), F.lit("a"), F.lit("B "), F.lit(""), F.lit("c")), ["C"])) == ["A", "B"]
    assert one(T.claim_preview(F.lit("x" * 70 + ". rest"))) == "x" * 70 + "." and one(T.claim_preview(F.lit("y" * 300))) == "y" * 260 + "…"
    assert one(T.critical_identifiers(F.lit("Fehler 0x80070005, KB1234567 und v1.2.3; `dism /Online /x` -1073; CVE-2024-12345 /no"))) == ["0x80070005", "kb1234567", "v1.2.3", "-1073", "cve-2024-12345", "/online"]
    assert one(R.category_hints(F.lit("VPN und Mail"))) == ["VPN-Verbindung", "Remote Access", "Gateway", "GlobalProtect", "Tunnel", "Verbindungsaufbau", "E-Mail", "Outlook", "Postfach", "E-Mail Versand und Empfang", "Exchange"]
    assert one(R.trend_text(F.lit("T"), F.lit(0.5), F.lit(0.25))) == 'Current evidence indicates a positive trajectory for "T" (score 0.50, progress 25%).'
