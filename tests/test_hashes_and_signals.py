"""Hashes and text signals against plain code."""

from __future__ import annotations

import hashlib
import math
import struct

from pyspark.sql import functions as F

from recallbase.functions import hashes as H
from recallbase.operators import rules as R

ALL = (1 << 64) - 1


def fnv(data):
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & ALL
    return h


def mixed(h):
    h = (h + 0x9E3779B97F4A7C15) & ALL
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & ALL
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & ALL
    return h ^ (h >> 31)


def unit(h):
    return ((h >> 11) + 0.5) / 2.0**53


def test_hashes(spark):
    ids = [f"id-{i}" for i in range(300)] + ["", "ä漢🙂"]
    shards, weights = ["a", "b", "c"], [1.0, 2.0, 1.0]
    df = spark.createDataFrame([(i,) for i in ids], "k string").select("k", H.fnv1a_hex("k").alias("f"), H.hnsw_level("k").alias("l"), H.rendezvous(shards, weights)("k").alias("s"))
    for r in df.collect():
        assert r.f == f"{fnv(r.k.encode()):016x}"
        assert r.l == min(32, math.floor(-math.log(unit(mixed(fnv(r.k.encode()))))))
        score = {s: w / -math.log(unit(mixed(fnv(f"{r.k}\0{s}".encode())))) for s, w in zip(shards, weights, strict=True)}
        assert r.s == max(shards, key=score.__getitem__)
    assert spark.createDataFrame([(None,)], "k string").select(H.fnv1a_hex("k")).first()[0] is None


def test_growing_takes_keys_to_the_new_shard_alone(spark):
    k = spark.range(500).select(F.col("id").cast("string").alias("k"))
    rows = k.select(H.rendezvous(["a", "b"], [1, 1])("k").alias("x"), H.rendezvous(["a", "b", "c"], [1, 1, 1])("k").alias("y")).collect()
    assert all(r.y in (r.x, "c") for r in rows) and 100 < sum(r.y == "c" for r in rows) < 240


def test_fingerprints(spark):
    v = [1.0, -0.5, 3.25]
    got = [r[0] for r in spark.createDataFrame([(v,), ([],), (None,)], "v array<float>").select(H.vector_fingerprint("v")).collect()]
    assert got == [hashlib.sha256(struct.pack("<3f", *v)).hexdigest()[:24], hashlib.sha256(b"").hexdigest()[:24], None]


TEXTS = {
    "multiple_users_affected": "Seit heute: mehrere Kolleginnen ohne Zugriff", "site_affected": "der ganzer Standort ist offline", "organization_affected": "die gesamte Verwaltung wartet", "workaround_available": "Andere Drucker im Flur funktionieren noch",
    "no_workaround": "es gibt keinen Workaround", "business_deadline": "Die Frist läuft ab", "security_incident_suspected": "Verdacht auf Phishing", "data_loss_possible": "Dateien gelöscht",
}


def found(spark, rows):
    got: dict[int, dict] = {}
    for r in R.signals(spark.createDataFrame(rows, "ticket_id int, subject string, content string")).collect():
        got.setdefault(r.ticket_id, {})[r.code] = r.excerpt
    return got


def test_signals(spark):
    rows = [(i, None, f"<p>Hallo,</p> {t}.") for i, t in enumerate(TEXTS.values())] + [(90, "", " und ".join(TEXTS.values())), (91, "nichts", "nichts"), (92, None, None), (93, "", ""), (94, None, "x" * 200 + " ransomware " + "y" * 200), (95, None, "antiphishing2")]
    got = found(spark, rows)
    for i, code in enumerate(TEXTS):
        assert code in got[i] and "<p>" not in got[i][code]
    assert set(TEXTS) <= set(got[90]) | {"workaround_available", "no_workaround"} and not {91, 92, 93, 95} & set(got)
    assert got[94]["security_incident_suspected"] == "…" + "x" * 89 + " ransomware " + "y" * 89 + "…"


def test_signals_of_written_examples(spark):
    """Each rule by a sentence of its own; the subject is read too. Borders are those of ASCII words, so a rule can't begin at an umlaut after a blank."""
    said = [
        ("Unsere Mitarbeiterinnen und ich warten", {"multiple_users_affected"}), ("Nutzer und ich", {"multiple_users_affected"}), ("sämtliche Arbeitsplätze", {"multiple_users_affected"}), ("wir  alle", {"multiple_users_affected"}), ("Kompletter Campus", {"site_affected"}),
        ("die ganze Behörde", {"organization_affected"}), ("Ersatzlösung gefunden", {"workaround_available"}), ("weitere Geräte am Platz gehen", {"workaround_available"}), ("Die Bürodrucker laufen noch.", {"workaround_available"}), ("Büro-Drucker gehen", {"workaround_available"}),
        ("Arbeitsplatz Drucker im Raum 5 noch verfügbar", {"workaround_available"}), ("ohne Ausweichmöglichkeit", {"no_workaround", "workaround_available"}), ("Termin ist bis 3.12", {"business_deadline"}), ("KONTO ÜBERNOMMEN", {"security_incident_suspected"}), ("Daten verloren", {"data_loss_possible"}), ("Datei überschrieben", set()),
        ("Ich kann nicht drucken.", set()), ("Terminal heute", set()), ("Bürodruckerei läuft", set()),
    ]
    rows = [(i, t, None) for i, (t, _) in enumerate(said)] + [(100 + i, None, t) for i, (t, _) in enumerate(said)]
    rows.append((200, "Probleme mit Flurdrucker", "<p>Meine Kollegen und ich können nicht mehr auf den Flur-Kopierern drucken.</p><p>Die Bürodrucker laufen noch.</p>"))
    got = found(spark, rows)
    for i, (t, want) in enumerate(said):
        assert set(got.get(i, {})) == set(got.get(100 + i, {})) == want, t
    assert set(got[200]) == {"multiple_users_affected", "workaround_available"}
