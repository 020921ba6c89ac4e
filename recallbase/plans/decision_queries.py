"""Ticket decisions, what became of them, drafts and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallbase.functions import exprs as X
from recallbase.functions import text as T
from recallbase.operators import aggregates as A
from recallbase.operators import drafts as D
from recallbase.operators import rules as R
from recallbase.operators import tickets as K
from recallbase.plans import views
from recallbase.plans.registry import query
from recallbase.plans.views import sql
from recallbase.session import table
from recallbase.sources import articles

c = F.col
SETTINGS = K.Settings(most=4, floor=0.3, gap=0.25, category_confidence=0.4, reply_confidence=0.35, evidence=0.4, sources=("src0", "src1", "SRC2 ", "src3"), reply_sources=("src0", "src1", "src2"))

_HITS = """hit AS MATERIALIZED (SELECT o_orderkey AS ticket_id, o_orderkey * 10 + s AS id, 'src' || ((o_custkey + s) % 6) AS source, CAST((o_orderkey * 13 + s * 37) % 100 AS DOUBLE) / 100e0 AS score, (o_custkey + s) % 4 AS cat, (o_orderkey + s) % 5 > 0 AS approved
    FROM orders, generate_series(1, 7) g(s)),
  answer AS (SELECT o_orderkey AS ticket_id, o_custkey % 6 AS wanted, CAST(o_orderkey % 11 AS DOUBLE) / 10e0 AS cat_conf, CASE WHEN o_orderkey % 9 > 0 THEN o_orderkey * 10 + 1 + o_custkey % 8 END AS reply_id, o_custkey % 7 > 0 AS reply_allowed, CAST(o_custkey % 10 AS DOUBLE) / 10e0 AS reply_conf FROM orders WHERE o_orderkey % 10 > 0),
  ticket AS (SELECT o_orderkey AS ticket_id, o_orderstatus <> 'P' AS open, o_custkey % 3 AS category_id FROM orders),
  ok AS MATERIALIZED (SELECT *, row_number() OVER w AS rank, greatest(0.3e0, max(score) OVER (PARTITION BY ticket_id) - 0.25e0) AS cutoff, max(score) OVER (PARTITION BY ticket_id) AS best FROM hit WHERE source IN ('src0', 'src1', 'src2', 'src3') WINDOW w AS (PARTITION BY ticket_id ORDER BY score DESC, id)),
  cand AS MATERIALIZED (SELECT *, best >= 0.3e0 AND score >= cutoff AND rank <= 4 AS sent FROM ok)"""
_WHY = "CASE WHEN sent THEN 'sent_to_ai' WHEN score < 0.3e0 THEN 'below_retrieval_floor' WHEN score < cutoff THEN 'outside_candidate_gap' WHEN rank > 4 THEN 'max_candidates_reached' ELSE 'not_selected' END"


def _case(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tickets, hits and answers from orders."""
    o = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("k"), c("o_custkey").alias("u"), "o_orderstatus")
    tickets = o.select(c("k").alias("ticket_id"), (c("o_orderstatus") != "P").alias("open"), (c("u") % 3).alias("category_id"), F.array(*[F.lit(i).cast("bigint") for i in (1, 2, 3, 4)]).alias("known_categories"))
    h = o.select("k", "u", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("s"))
    cat = (c("u") + c("s")) % 4
    hits = h.select(c("k").alias("ticket_id"), (c("k") * 10 + c("s")).alias("id"), F.concat(F.lit("src"), ((c("u") + c("s")) % 6).cast("string")).alias("source"), (((c("k") * 13 + c("s") * 37) % 100).cast("double") / 100).alias("score"), F.when(cat == 0, F.array().cast("array<bigint>")).otherwise(F.array(cat)).alias("categories"), ((c("k") + c("s")) % 5 > 0).alias("approved"))
    answers = o.where("k % 10 > 0").select(c("k").alias("ticket_id"), (c("u") % 6).alias("category_id"), ((c("k") % 11).cast("double") / 10).alias("category_confidence"), F.when(c("k") % 9 > 0, c("k") * 10 + 1 + c("u") % 8).alias("reply_id"), (c("u") % 7 > 0).alias("reply_allowed"), ((c("u") % 10).cast("double") / 10).alias("reply_confidence"))
    return tickets, hits, answers


@query("p10_selection_reason", f"WITH {_HITS} SELECT ticket_id, id, rank, sent, {_WHY} AS reason FROM cand")
def p10(spark, sf_dir):
    _, hits, _ = _case(spark, sf_dir)
    return K.candidates(hits, SETTINGS).select("ticket_id", "id", c("rank").cast("long").alias("rank"), "sent", "reason")


@query("p18_ticket_pipeline", f"""WITH {_HITS},
  n AS (SELECT ticket_id, count(*) FILTER (sent) AS n FROM cand GROUP BY ticket_id),
  j AS (SELECT t.*, coalesce(n.n, 0) AS n, a.ticket_id IS NOT NULL AS there, wanted, cat_conf, a.reply_id, reply_allowed, reply_conf, h.id IS NOT NULL AS found, h.sent, h.score, h.source, h.cat, h.approved
    FROM ticket t LEFT JOIN n USING (ticket_id) LEFT JOIN answer a USING (ticket_id) LEFT JOIN cand h ON h.ticket_id = t.ticket_id AND h.id = a.reply_id),
  k AS (SELECT *, CASE WHEN NOT open THEN 'ticket_not_open' WHEN NOT there THEN 'model_answer_missing' WHEN NOT wanted > 0 THEN 'category_not_recommended' WHEN wanted > 4 THEN 'category_unknown' WHEN wanted = category_id THEN 'category_unchanged' WHEN cat_conf < 0.4e0 THEN 'category_confidence_below_threshold' ELSE 'category_accepted' END AS cd FROM j),
  e AS (SELECT *, CASE WHEN cd = 'category_accepted' THEN wanted ELSE category_id END AS eff FROM k),
  f AS (SELECT *, cat = 0 OR cat = eff AS fits, CASE WHEN cat > 0 THEN (0.45e0 * score + 0.35e0 * reply_conf + CASE WHEN cat = eff THEN 0.2e0 ELSE 0e0 END) ELSE (0.45e0 * score + 0.35e0 * reply_conf) / 0.8e0 END AS ev FROM e),
  r AS (SELECT *, CASE WHEN NOT open THEN 'ticket_not_open' WHEN NOT there THEN 'model_answer_missing' WHEN n = 0 THEN 'reply_no_knowledge_candidates' WHEN NOT reply_allowed THEN 'reply_model_not_recommended' WHEN reply_conf < 0.35e0 THEN 'reply_confidence_below_threshold'
    WHEN reply_id IS NULL THEN 'reply_no_knowledge_selected' WHEN NOT found THEN 'reply_knowledge_not_found' WHEN NOT sent THEN 'reply_knowledge_not_sent' WHEN source = 'src3' THEN 'reply_source_not_allowed' WHEN NOT approved THEN 'reply_knowledge_auto_reply_not_approved'
    WHEN NOT fits THEN 'reply_category_mismatch' WHEN round(ev, 9) < 0.4e0 THEN 'reply_knowledge_evidence_below_threshold' ELSE 'reply_accepted' END AS rd FROM f)
  SELECT ticket_id, n AS candidates_sent, cd AS category_decision, CASE WHEN cd = 'category_accepted' THEN wanted END AS new_category, rd AS reply_decision, CASE WHEN rd = 'reply_accepted' THEN reply_id END AS reply_id, CASE WHEN found THEN round(ev, 9) END AS evidence FROM r""")
def p18(spark, sf_dir):
    return K.process(*_case(spark, sf_dir), SETTINGS).withColumn("evidence", F.round("evidence", 9))


@query("p19_candidate_diagnosis", f"""WITH {_HITS}, asked AS (SELECT o_orderkey AS ticket_id, o_orderkey * 10 + 1 + o_custkey % 8 AS id FROM orders), b AS (SELECT DISTINCT ticket_id, cutoff FROM cand),
  j AS (SELECT a.ticket_id, a.id, c.rank, h.score, coalesce(b.cutoff, 0.3e0) AS cutoff, coalesce(c.sent, FALSE) AS sent, h.id IS NOT NULL AS found, c.id IS NOT NULL AS allowed FROM asked a LEFT JOIN hit h ON h.ticket_id = a.ticket_id AND h.id = a.id LEFT JOIN cand c ON c.ticket_id = a.ticket_id AND c.id = a.id LEFT JOIN b ON b.ticket_id = a.ticket_id)
  SELECT ticket_id, id, coalesce(rank, 0) AS rank, score, round(cutoff, 9) AS cutoff, sent, CASE WHEN NOT found THEN 'not_in_active_index' WHEN NOT allowed THEN 'source_not_allowed_for_purpose' ELSE {_WHY} END AS reason,
    concat_ws(',', CASE WHEN NOT found THEN 'candidate_in_active_index' END, CASE WHEN NOT allowed THEN 'candidate_source_for_purpose' END, CASE WHEN NOT coalesce(allowed AND score >= 0.3e0, FALSE) THEN 'candidate_retrieval_floor' END, CASE WHEN NOT coalesce(allowed AND score >= cutoff, FALSE) THEN 'candidate_dynamic_cutoff' END, CASE WHEN NOT sent THEN 'candidate_sent_to_ai' END) AS failed FROM j""")
def p19(spark, sf_dir):
    _, hits, _ = _case(spark, sf_dir)
    asked = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("ticket_id"), (c("o_orderkey") * 10 + 1 + c("o_custkey") % 8).alias("id"))
    return K.diagnose(asked, hits, SETTINGS).select("ticket_id", "id", c("rank").cast("long").alias("rank"), "score", F.round("cutoff", 9).alias("cutoff"), "sent", "reason", F.array_join("failed", ",").alias("failed"))


_RUNS = """run AS (SELECT o_orderkey AS run_id, CASE WHEN o_custkey % 4 = 0 THEN '' ELSE o_orderstatus END AS v, CASE WHEN o_custkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS f, CASE WHEN o_orderkey % 6 > 0 THEN ' Proposal ' || o_orderkey END AS proposed, CASE WHEN o_orderkey % 13 > 0 THEN 'in' ELSE ' ' END AS input,
    o_custkey % 3 AS basis, o_custkey % 2 AS ai, 9 AS before, CASE WHEN o_orderkey % 2 = 0 THEN 'kb-' || o_orderkey ELSE '' END AS ak, 'kb-old' AS k FROM orders),
  said AS (SELECT event_id AS id, user_id * 4 + event_id % 2 AS run_id, ts, CASE event_id % 5 WHEN 0 THEN ' Accepted' WHEN 1 THEN 'corrected' WHEN 2 THEN 'maybe' ELSE 'accepted' END AS decision, CASE WHEN event_id % 3 > 0 THEN '<b>Better</b>  ' || event_type END AS corrected, CASE WHEN event_id % 7 > 0 THEN 'ann' ELSE ' ' END AS actor FROM events),
  j AS (SELECT s.id, s.run_id, s.ts, lower(trim(s.decision)) AS decision, CASE WHEN lower(trim(s.decision)) = 'accepted' THEN trim(coalesce(proposed, '')) ELSE trim(regexp_replace(regexp_replace(coalesce(corrected, ''), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) END AS confirmed, coalesce(corrected, '') AS corrected,
    r.run_id IS NOT NULL AS there, v, f, coalesce(proposed, '') AS proposed, input, CASE WHEN basis > 0 THEN basis WHEN ai > 0 THEN ai ELSE before END AS category_id, CASE WHEN ak <> '' THEN ak ELSE coalesce(k, '') END AS knowledge_id, CASE WHEN trim(actor) <> '' THEN actor ELSE 'technician' END AS actor FROM said s LEFT JOIN run r ON r.run_id = s.run_id),
  g AS (SELECT *, CASE WHEN NOT there THEN 'run_not_found' WHEN v <> '' AND v <> f THEN 'ticket_changed' WHEN trim(proposed) = '' THEN 'no_reply_proposal' WHEN decision NOT IN ('accepted', 'corrected') THEN 'unknown_decision' WHEN decision = 'corrected' AND corrected = '' THEN 'correction_without_text' WHEN trim(input) = '' THEN 'no_learning_input' ELSE 'recorded' END AS st FROM j),
  o AS (SELECT *, lag(decision || chr(1) || confirmed) OVER (PARTITION BY run_id, st ORDER BY ts, id) AS same FROM g),
  q AS (SELECT *, CASE WHEN st = 'recorded' AND same = decision || chr(1) || confirmed THEN 'repeated' ELSE st END AS state FROM o),
  p AS (SELECT *, lag(id) OVER (PARTITION BY run_id, state ORDER BY ts, id) AS before_id FROM q)""".replace("\\\\", "\\")


def _outcomes(spark, sf_dir) -> DataFrame:
    k, u = c("o_orderkey"), c("o_custkey")
    runs = table(spark, sf_dir, "orders").select(
        k.alias("run_id"), F.when(u % 4 == 0, "").otherwise(c("o_orderstatus")).alias("source_version"), F.when(u % 5 == 0, "X").otherwise(c("o_orderstatus")).alias("fresh_version"), F.when(k % 6 > 0, F.concat(F.lit(" Proposal "), k.cast("string"))).alias("proposed"), F.when(k % 13 > 0, "in").otherwise(" ").alias("input"),
        (u % 3).alias("basis_category"), (u % 2).alias("ai_category"), F.lit(9).cast("long").alias("category_before"), F.when(k % 2 == 0, F.concat(F.lit("kb-"), k.cast("string"))).otherwise("").alias("ai_knowledge"), F.lit("kb-old").alias("knowledge"),
    )
    e = c("event_id")
    said = table(spark, sf_dir, "events").select(
        e.alias("id"), (c("user_id") * 4 + e % 2).alias("run_id"), c("ts").alias("at"), F.when(e % 5 == 0, " Accepted").when(e % 5 == 1, "corrected").when(e % 5 == 2, "maybe").otherwise("accepted").alias("decision"),
        F.when(e % 3 > 0, F.concat(F.lit("<b>Better</b>  "), "event_type")).alias("corrected"), F.when(e % 7 > 0, "ann").otherwise(" ").alias("actor"),
    )
    return K.record_outcomes(runs, said)


@query("r35_outcome_recording", f"""WITH {_RUNS} SELECT id, run_id, state, decision, CASE WHEN there THEN confirmed ELSE CASE WHEN decision = 'accepted' THEN '' ELSE confirmed END END AS confirmed, category_id, CASE WHEN there THEN knowledge_id ELSE '' END AS knowledge_id, actor,
  CASE WHEN state = 'recorded' THEN 'pending' END AS sync_status, CASE WHEN state = 'recorded' THEN before_id END AS supersedes FROM p""")
def r35(spark, sf_dir):
    return _outcomes(spark, sf_dir)


@query("r48_outcome_memories", f"""WITH {_RUNS}, x AS (SELECT *, CASE WHEN state = 'recorded' THEN before_id END AS sup FROM p WHERE state = 'recorded')
  SELECT id, 'desk.outcome.' || decision AS source, CASE WHEN decision = 'corrected' THEN 1e0 ELSE 0.99e0 END AS confidence,
    md5('DESK helpdesk outcome verified by a technician.' || chr(10) || chr(10) || 'Problem:' || chr(10) || 'in' || chr(10) || chr(10) || 'Verified solution:' || chr(10) || confirmed || CASE WHEN category_id = 2 THEN '' ELSE chr(10) || chr(10) || 'Category: Printers' || CASE WHEN category_id > 0 THEN ' (#' || category_id || ')' ELSE '' END END) AS text_hash,
    concat_ws(',', 'integration:desk', 'validated:human', 'outcome:' || decision, 'ticket:' || run_id % 1000, 'run:' || run_id, CASE WHEN category_id > 0 AND category_id <> 2 THEN 'category:' || category_id END, CASE WHEN knowledge_id <> '' THEN 'knowledge:' || knowledge_id END, CASE WHEN sup IS NOT NULL THEN 'supersedes-outcome:' || sup END) AS tags FROM x""")
def r48(spark, sf_dir):
    good = _outcomes(spark, sf_dir).where("state = 'recorded'")
    told = good.select("id", (c("run_id") % 1000).alias("ticket_id"), "run_id", "decision", F.lit("in").alias("input"), "confirmed", F.when(c("category_id") != 2, c("category_id")).alias("category_id"), F.when(c("category_id") != 2, "Printers").alias("category_name"), "knowledge_id", "supersedes")
    return K.outcome_memory(told, "desk").select("id", "source", "confidence", F.md5("text").alias("text_hash"), F.array_join("tags", ",").alias("tags"))


@query("r47_integration_events", """WITH e AS (SELECT event_id AS id, CASE WHEN event_id % 3 > 0 THEN 'q ' || event_type ELSE ' ' END AS q, event_id % 11 AS n, value FROM events)
  SELECT id, CASE WHEN trim(q) <> '' THEN q END AS query, CASE WHEN n > 0 THEN CAST(n AS VARCHAR) END AS hit_count, CASE WHEN n > 0 THEN 'm-1:' || printf('%.4f', 0.125e0) END AS hit_1, CASE WHEN n >= 8 THEN 'm-8:' || printf('%.4f', 1e0) END AS hit_8, 2 + CAST(trim(q) <> '' AS INT) + CASE WHEN n > 0 THEN 1 + least(n, 8) ELSE 0 END AS entries FROM e""")
def r47(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(c("event_id").alias("id"), F.when(c("event_id") % 3 > 0, F.concat(F.lit("q "), "event_type")).otherwise(" ").alias("q"), (c("event_id") % 11).cast("int").alias("n"))
    hits = F.when(c("n") > 0, F.transform(F.sequence(F.lit(1), F.greatest(c("n"), F.lit(1))), lambda i: F.struct(F.concat(F.lit("m-"), i.cast("string")).alias("id"), (i.cast("double") / 8).alias("score"))))
    own = F.create_map(F.lit("a"), F.lit("1"), F.lit(" "), F.lit("2"), F.lit("b"), F.lit("3"))
    m = e.select("id", K.event_metadata(own, c("q"), hits).alias("m"))
    return m.select("id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("query", "hit_count", "hit_1", "hit_8")], F.size("m").cast("long").alias("entries"))


@query("r53_common_digest", """WITH d AS (SELECT l_partkey AS model, CASE WHEN l_linenumber > 5 THEN ' ' WHEN l_partkey % 3 = 0 THEN 'sha-' || l_returnflag ELSE ' sha-A' END AS digest FROM lineitem), g AS (SELECT model, count(DISTINCT CASE WHEN trim(digest) <> '' THEN trim(digest) END) AS n, max(CASE WHEN trim(digest) <> '' THEN trim(digest) END) AS d FROM d GROUP BY model)
  SELECT model, CASE WHEN n <= 1 THEN coalesce(d, '') ELSE '' END AS digest, n > 1 AS mismatch FROM g""")
def r53(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    return K.common_digest(x.select(c("l_partkey").alias("model"), F.when(c("l_linenumber") > 5, " ").when(c("l_partkey") % 3 == 0, F.concat(F.lit("sha-"), "l_returnflag")).otherwise(" sha-A").alias("digest")), "model")


@query("r49_suspicious_ids", "SELECT DISTINCT c_nationkey AS id FROM customer WHERE c_nationkey NOT IN (SELECT doc_id % 12 FROM documents) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def r49(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select(F.array(c("doc_id") % 12).alias("categories"))
    return K.suspicious_ids(table(spark, sf_dir, "customer").select(c("c_nationkey").cast("long").alias("id")), items, table(spark, sf_dir, "nation").where("n_regionkey < 3").select(c("n_nationkey").cast("long").alias("id")))


_LABELS = """lab AS (SELECT doc_id AS id, unnest(CASE doc_id % 4 WHEN 0 THEN ['Net  ' || doc_id % 9, 'mail'] WHEN 1 THEN ['NET ' || doc_id % 9, ' '] WHEN 2 THEN ['Mail', 'mail '] ELSE [] END) AS label FROM documents),
  seen AS (SELECT lower(trim(regexp_replace(label, '\\s+', ' ', 'g'))) AS n, count(DISTINCT id) AS used, min(trim(label)) AS label FROM lab WHERE trim(label) <> '' GROUP BY 1),
  told AS (SELECT lower(n_name) AS n, n_name AS label, [n_nationkey + 1] AS ids FROM nation UNION ALL SELECT 'net ' || i, 'Net ' || i, list_sort(list_distinct([i + 1, 70])) FROM generate_series(0, 4) g(i))""".replace("\\\\", "\\")


def _labels(spark, sf_dir) -> DataFrame:
    k = c("doc_id") % 4
    n = (c("doc_id") % 9).cast("string")
    labels = F.when(k == 0, F.array(F.concat(F.lit("Net  "), n), F.lit("mail"))).when(k == 1, F.array(F.concat(F.lit("NET "), n), F.lit(" "))).when(k == 2, F.array(F.lit("Mail"), F.lit("mail "))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "documents").select(c("doc_id").alias("id"), labels.alias("labels"))


def _stored(spark, sf_dir) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(c("n_name").alias("label"), F.array(c("n_nationkey").cast("long") + 1).alias("ids"))
    nets = spark.range(5).select(F.concat(F.lit("Net "), c("id").cast("string")).alias("label"), F.array(c("id") + 1).alias("ids"))
    more = spark.range(7).select(F.concat(F.lit("NET  "), c("id").cast("string")).alias("label"), F.when(c("id") < 5, F.array(F.lit(70).cast("long"))).otherwise(F.array().cast("array<bigint>")).alias("ids"))
    return K.save_mapping(nations.unionByName(nets).unionByName(more))


@query("a07_mapping_usage", f"""WITH {_LABELS} SELECT coalesce(seen.n, told.n) AS normalized, coalesce(seen.label, told.label) AS label, coalesce(used, 0) AS used, coalesce(array_to_string(ids, ','), '') AS ids, CASE WHEN used IS NULL THEN 'orphan' WHEN ids IS NULL THEN 'unmapped' ELSE 'mapped' END AS state FROM seen FULL JOIN (SELECT n, CASE WHEN label LIKE 'Net%' THEN 'NET  ' || right(label, 1) ELSE label END AS label, ids FROM told) told ON told.n = seen.n""")
def a07(spark, sf_dir):
    return K.mapping_usage(_labels(spark, sf_dir), _stored(spark, sf_dir)).select("normalized", "label", "used", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), "state")


@query("r43_mapping_save", f"""WITH {_LABELS}, j AS (SELECT d.doc_id AS id, lab.label, told.ids FROM documents d LEFT JOIN lab ON lab.id = d.doc_id LEFT JOIN told ON told.n = lower(trim(regexp_replace(lab.label, '\\s+', ' ', 'g'))))
  SELECT id, coalesce(array_to_string(list_sort(list_distinct(flatten(list(ids) FILTER (ids IS NOT NULL)))), ','), '') AS ids, coalesce(array_to_string(list_sort(list_distinct(list(trim(label)) FILTER (ids IS NULL AND trim(label) <> ''))), ','), '') AS unmapped FROM j GROUP BY id""".replace("\\\\", "\\"))
def r43(spark, sf_dir):
    d = K.mapped_documents(_labels(spark, sf_dir), _stored(spark, sf_dir))
    return d.select("id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), F.array_join("unmapped", ",").alias("unmapped"))


_JSON = ('{"title": "a", "Text": 1}', '{"title": "a"} x', '{"title": "a"}{"b": 2}', '[1]', '{"title":', '{"other": 1}', 'null', '', ' {"text": {"c": 1}} ', "{'title': 1}", '{"title": "x"}, "z": 2', '{"title": NaN}')
_VERDICT = ("", "multiple_values", "multiple_values", "not_an_object", "invalid", "unknown_field", "not_an_object", "invalid", "", "invalid", "multiple_values", "invalid")


@query("c39_strict_json", "SELECT doc_id, CASE doc_id % 12 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_VERDICT)) + " END AS error FROM documents")
def c39(spark, sf_dir):
    raw = F.get(F.array(*[F.lit(x) for x in _JSON]), (c("doc_id") % 12).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(D.strict_object(raw, ("title", "text"))["error"], F.lit("")).alias("error"))


_ESCAPES = (r'{"a": "C:\Users\x"}', r'{"a": "tab\t ok \u00e4"}', r'{"a": "\\already"}', r'{"a": "\q\\z"}', r'plain')
_REPAIRED = (r'{"a": "C:\\Users\\x"}', r'{"a": "tab\t ok \u00e4"}', r'{"a": "\\already"}', r'{"a": "\\q\\z"}', r'plain')


@query("c38_escape_repair", "SELECT doc_id, CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_REPAIRED)) + " END AS repaired FROM documents")
def c38(spark, sf_dir):
    raw = F.get(F.array(*[F.lit(x) for x in _ESCAPES]), (c("doc_id") % 5).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", T.repair_escapes(raw).alias("repaired"))


@query("c40_prompt_context", sql("""r AS (SELECT label AS query_id, id, memory_type, status, source, salience, text, row_number() OVER (PARTITION BY label ORDER BY salience DESC, id) AS rank FROM memory)
  SELECT query_id, md5(trim(string_agg('[' || rank || ' | type=' || memory_type || ' | status=' || status || ' | shard=' || source || ' | sim=' || printf('%.3f', salience) || ' | id=' || id || '] ' || text, chr(10) ORDER BY rank))) AS context FROM r WHERE rank <= 6 GROUP BY query_id""", "memory"))
def c40(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("label").orderBy(F.desc("salience"), "id")
    m = views.memory(spark, sf_dir).select(c("label").alias("query_id"), "id", "memory_type", "status", c("source").alias("shard"), c("salience").alias("similarity"), "text", F.row_number().over(w).alias("rank"))
    return D.prompt_context(m, 6).select("query_id", F.md5("context").alias("context"))


@query("r08_any_relevant", sql(r"""w AS (SELECT n_chars % 40 AS goal_id, list_filter(regexp_split_to_array(lower(concat_ws(' ', title, source)), '[^\p{L}\p{Nd}]+'), lambda t: t <> '') AS w FROM kdoc)
  SELECT goal_id, bool_or(len(list_intersect(['that', 'src1', 'inthe'], list_distinct(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || w[i + 1]))))) >= 2) AS relevant FROM w GROUP BY goal_id""", "kdoc"))
def r08(spark, sf_dir):
    d = views.kdoc(spark, sf_dir).select((c("n_chars") % 40).alias("goal_id"), "title", "source")
    return D.any_relevant(d, T.strings("that", "src1", "inthe"), "title", "source")


@query("r11_goal_reconcile", sql("""e AS (SELECT goal_id, count(DISTINCT memory_id) AS evidence, count(DISTINCT source_id) AS sources, count(DISTINCT CASE WHEN type = 'evidence.corroborated' THEN memory_id * 1000 + source_id END) AS corroborations
    FROM research_event WHERE type IN ('evidence.learned', 'evidence.corroborated') GROUP BY goal_id), g AS (SELECT DISTINCT goal_id FROM research_event UNION SELECT 99)
  SELECT g.goal_id, round(CASE WHEN e.goal_id IS NULL THEN 0.05e0 * 0.5e0 ELSE least(1e0, 0.55e0 * least(1e0, evidence / 20e0) + 0.25e0 * least(1e0, sources / 8e0) + 0.15e0 * least(1e0, corroborations / 5e0) + 0.05e0 * 0.5e0) END, 9) AS progress, CASE WHEN e.goal_id IS NULL THEN TRUE ELSE round(least(1e0, 0.55e0 * least(1e0, evidence / 20e0) + 0.25e0 * least(1e0, sources / 8e0) + 0.15e0 * least(1e0, corroborations / 5e0) + 0.05e0 * 0.5e0), 9) <> 0.975e0 END AS changed FROM g LEFT JOIN e USING (goal_id)""", "research_event"))
def r11(spark, sf_dir):
    """Every goal's progress counted anew from its evidence, goals without any included, and whether it differs from the one stored."""
    events = views.research_event(spark, sf_dir)
    goals = events.select("goal_id").distinct().union(spark.range(99, 100).select(c("id").alias("goal_id"))).withColumn("progress", F.lit(0.975))
    return A.reconciled_goals(goals, events).withColumn("progress", F.round("progress", 9))


@query("r13_article_quality", "SELECT doc_id, length(trim(text)) AS text_chars, length(trim(source)) AS answer_chars, 200 AS min_text_chars, 900 AS target_text_chars, 3000 AS max_text_chars, doc_id % 9 AS evidence_items, 2 AS evidence_prompt_chars, doc_id % 2 = 0 AS expansion_applied, n_chars AS synthesis_tokens FROM documents")
def r13(spark, sf_dir):
    q = D.quality(c("text"), c("source"), c("lang"), c("doc_id") % 9, c("doc_id") % 2 == 0, c("n_chars"), (200, 900, 3000))
    return table(spark, sf_dir, "documents").select("doc_id", q.alias("q")).select("doc_id", "q.*")


@query("r52_fallback_search", "WITH h AS (SELECT item_id, count(d.doc_id) AS total FROM benchmark b LEFT JOIN documents d ON d.lang = 'xx' OR (b.item_id % 2 = 0 AND d.doc_id = b.item_id) GROUP BY item_id) SELECT item_id, total, total = 0 AS fallback FROM h")
def r52(spark, sf_dir):
    """A search that found nothing is asked of the model."""
    b = table(spark, sf_dir, "benchmark").select("item_id")
    hits = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").groupBy(c("doc_id").alias("item_id")).agg(F.count("*").alias("n"))
    return A.search_totals(b, hits, "item_id")


@query("r40_embedding_batches", "SELECT doc_id AS id, CAST(length(text) AS DOUBLE) AS chars, CAST(strlen(text) AS DOUBLE) AS bytes, 64 >= 64 AS bounded FROM documents")
def r40(spark, sf_dir):
    def embed(texts: list[str]) -> list[list[float]]:
        return [[float(len(t)), float(len(t.encode())), float(len(texts))] for t in texts]

    v = D.embedded(table(spark, sf_dir, "documents").select(c("doc_id").alias("id"), "text"), embed)
    return v.select("id", c("vector")[0].alias("chars"), c("vector")[1].alias("bytes"), (c("vector")[2] <= 64).alias("bounded"))


@query("v04_candidate_provenance", sql("""h AS (SELECT id % 30 AS query_id, id AS i, salience AS s, n FROM memory, (SELECT unnest([0, 1]) AS n) WHERE (n = 0 AND id % 2 = 0) OR (n = 1 AND id % 3 = 0)), g AS (SELECT query_id, i, max(s) AS s, list_sort(list(DISTINCT n)) AS n FROM h GROUP BY query_id, i),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, i) AS rank FROM g) SELECT query_id, i AS id, round(s, 9) AS similarity, CASE WHEN len(n) = 2 THEN 'hnsw+disk-pq' WHEN n[1] = 0 THEN 'hnsw' ELSE 'disk-pq' END AS candidate_source, rank FROM r WHERE rank <= 5""", "memory"))
def v04(spark, sf_dir):
    m = views.memory(spark, sf_dir).select((c("id") % 30).alias("query_id"), "id", c("salience").alias("similarity"))
    g = D.merged_candidates([("hnsw", m.where("id % 2 = 0")), ("disk-pq", m.where("id % 3 = 0"))], 5)
    return g.select("query_id", "id", F.round("similarity", 9).alias("similarity"), "candidate_source", c("rank").cast("long").alias("rank"))


@query("v26_synthetic_vectors")
def v26(spark, sf_dir):
    """As many as there are embeddings; a test compares them with plain integers."""
    return D.synthetic_vectors(spark, table(spark, sf_dir, "embeddings").count(), 16)


@query("x19_knowledge_scores", sql("""SELECT id, round(0.55e0 * confidence + 0.25e0 * least(greatest((reward + 1) / 2e0, 0e0), 1e0) + 0.20e0 * least(greatest(salience / 2e0, 0e0), 1e0), 9) AS score FROM memory""", "memory"))
def x19(spark, sf_dir):
    return views.memory(spark, sf_dir).select("id", F.round(X.knowledge_score(c("confidence"), c("reward"), c("salience")), 9).alias("score"))


@query("x21_display_priority", sql("""SELECT id, round(salience + 0.5e0 * confidence + 0.01e0 * access_count + CASE WHEN status = 'active' THEN 0.5e0 ELSE 0e0 END + CASE WHEN id % 4 = 0 THEN 1e0 ELSE 0e0 END + CASE WHEN id % 4 = 1 THEN 0.4e0 ELSE 0e0 END, 9) AS priority FROM memory""", "memory"))
def x21(spark, sf_dir):
    return views.memory(spark, sf_dir).select("id", F.round(X.display_priority(c("salience"), c("confidence"), c("access_count"), c("status") == "active", c("id") % 4 == 0, c("id") % 4 == 1), 9).alias("priority"))


@query("f17_category_gate", "SELECT o_orderkey AS id, o_custkey % 3 = 0 OR o_custkey % 5 = o_orderkey % 5 AS allowed FROM orders")
def f17(spark, sf_dir):
    cats = F.when(c("o_custkey") % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array(c("o_custkey") % 5))
    return table(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), R.category_allowed(cats, c("o_orderkey") % 5).alias("allowed"))


@query("f21_glob_ignore", "SELECT page_id, url, regexp_matches(url, '(^|/)[^/]*[.]html$') OR regexp_matches(url, '(^|/)page[12][^/]$') AS ignored FROM pages")
def f21(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", articles.ignored(c("url"), ["*.html", "page[12]?", " "]).alias("ignored"))


@query("c02_token_sets", sql(r"w AS (SELECT id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]{3,}'), lambda t: t NOT IN (" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + ")))AS t FROM kdoc) SELECT id, len(t) AS n, md5(array_to_string(list_sort(t), ' ')) AS tokens FROM w", "kdoc"))
def c02(spark, sf_dir):
    t = views.kdoc(spark, sf_dir).select("id", T.tokens(c("text")).alias("t"))
    return t.select("id", F.size("t").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("tokens"))


@query("c04_research_words", sql(r"w AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+'), lambda t: t <> '') AS t FROM kdoc) SELECT id, len(t) AS n, md5(array_to_string(t, ' ')) AS words FROM w", "kdoc"))
def c04(spark, sf_dir):
    w = views.kdoc(spark, sf_dir).select("id", T.research_words(c("text")).alias("w"))
    return w.select("id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("words"))


@query("c11_search_excerpts", r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), a AS (SELECT *, least(nullif(strpos(lower(t), 'license'), 0), nullif(strpos(lower(t), 'password'), 0)) AS place FROM f), s AS (SELECT *, greatest(place - 91, 0) AS start FROM a)
  SELECT doc_id, md5(CASE WHEN place IS NULL THEN substring(t, 1, 300) ELSE CASE WHEN start > 0 THEN '… ' ELSE '' END || trim(substring(t, start + 1, 320)) || CASE WHEN start + 320 < length(t) THEN ' …' ELSE '' END END) AS excerpt FROM s""")
def c11(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.search_excerpt(c("text"), ["license", "password"])).alias("excerpt"))


_CODES = ("run `sfc /scannow` now", "path /scannow outside", "```\ndism /Online /Cleanup-Image\n``` 0x80070005 KB5001234", "CVE-2024-12345 and v1.2.3 at -403", "a `(/quiet)` b")
_FOUND = ("/scannow", "", "0x80070005,kb5001234,/online,/cleanup-image", "cve-2024-12345,v1.2.3,-403", "/quiet")


@query("c18_critical_identifiers", "SELECT doc_id, CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_FOUND)) + " END AS found FROM documents")
def c18(spark, sf_dir):
    """c18, c19: identifiers of written examples, slash switches within code alone."""
    t = F.get(F.array(*[F.lit(x) for x in _CODES]), (c("doc_id") % 5).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.critical_identifiers(t), ",").alias("found"))
