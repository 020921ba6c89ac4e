"""Decisions, predicates, joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recallbase.functions import exprs as X
from recallbase.functions import text as T
from recallbase.operators import jobs as J
from recallbase.operators import rules as R
from recallbase.operators import tickets as K
from recallbase.operators.shared import small
from recallbase.plans import hash_sql, views
from recallbase.plans.registry import query
from recallbase.plans.views import sql
from recallbase.session import table

_POLICY = R.ReplyPolicy(language="de", style="sie", sources=("src0", "src1", "src2", "src3", "src4"), reply_sources=("src0", "src1", "src2"), knowledge_min_score=0.5, reply_confidence=0.3)


@query("p01_reply_policy", sql("""d AS (SELECT id, source, language, auto_reply, n_chars, n_chars % 7 AS cand, n_chars % 5 > 0 AS allowed, CAST(n_chars % 100 AS DOUBLE) / 100 AS conf, n_chars % 11 > 0 AS picked, n_chars % 13 = 0 AS incomplete, n_chars % 17 = 0 AS incident, CAST(n_chars % 90 AS DOUBLE) / 90 AS score FROM kdoc),
  e AS (SELECT *, least(1e0, (score * 0.45e0 + conf * 0.35e0) / (0.45e0 + 0.35e0)) AS ev FROM d)
  SELECT id, CASE WHEN NOT cand > 0 THEN 'reply_no_knowledge_candidates' WHEN NOT allowed THEN 'reply_model_not_recommended' WHEN conf < 0.3e0 THEN 'reply_confidence_below_threshold' WHEN NOT picked THEN 'reply_no_knowledge_selected' WHEN incomplete THEN 'reply_context_incomplete'
    WHEN incident THEN 'reply_relevant_incident' WHEN source NOT IN ('src0', 'src1', 'src2', 'src3', 'src4') THEN 'reply_source_not_allowed' WHEN source NOT IN ('src0', 'src1', 'src2') THEN 'reply_source_not_allowed_for_auto_reply' WHEN language <> 'de' THEN 'reply_language_mismatch'
    WHEN NOT coalesce(auto_reply, FALSE) THEN 'reply_knowledge_auto_reply_not_approved' WHEN score < 0.35e0 THEN 'reply_knowledge_retrieval_below_floor' WHEN ev < 0.5e0 THEN 'reply_knowledge_evidence_below_threshold' ELSE 'reply_accepted' END AS decision FROM e""", "kdoc"))
def p01(spark, sf_dir):
    n = F.col("n_chars")
    conf, score = (n % 100).cast("double") / 100, (n % 90).cast("double") / 90
    c = {
        "candidates": n % 7, "allowed": n % 5 > 0, "confidence": conf, "knowledge_id": F.when(n % 11 > 0, F.col("id").cast("string")), "incomplete": n % 13 == 0, "incident": n % 17 == 0, "found": F.lit(True), "source": F.col("source"), "language": F.col("language"), "style": F.lit("Sie"),
        "auto_reply": F.col("auto_reply"), "score": score, "evidence": X.evidence_score(score, conf, F.lit(0.0), F.lit(False)), "min_score": F.lit(None).cast("double"), "answer": F.col("text"), "categories": F.array().cast("array<bigint>"), "effective": F.lit(0).cast("long"),
    }
    return views.kdoc(spark, sf_dir).select("id", R.decide(R.reply_gates(_POLICY, c), "reply_accepted").alias("decision"))


@query("p02_priority", """WITH t AS (SELECT o_orderkey AS id, o_orderkey % 7 AS cur, o_custkey % 8 AS want, CAST(o_custkey % 100 AS DOUBLE) / 100 AS conf, CASE o_orderkey % 4 WHEN 0 THEN 'multiple_users_affected' WHEN 1 THEN 'single_user_affected' WHEN 2 THEN 'insufficient_information' ELSE 'odd' END AS reason FROM orders),
  d AS (SELECT *, CASE WHEN want NOT BETWEEN 1 AND 6 THEN 'priority_invalid_recommendation' WHEN cur NOT BETWEEN 1 AND 6 THEN 'priority_current_unknown' WHEN want < cur THEN 'priority_decrease_blocked' WHEN want = cur AND reason = 'insufficient_information' THEN 'priority_no_change_insufficient_information'
    WHEN want = cur THEN 'priority_already_matches' WHEN reason = 'insufficient_information' THEN 'priority_insufficient_information' WHEN conf < 0.6e0 THEN 'priority_confidence_below_threshold' WHEN reason <> 'multiple_users_affected' THEN 'priority_reason_not_allowed' ELSE 'priority_accepted' END AS decision FROM t)
  SELECT id, decision, CASE WHEN decision = 'priority_accepted' THEN least(want, cur + 2, 6) ELSE cur END AS priority FROM d""")
def p02(spark, sf_dir):
    reason = F.element_at(F.array(F.lit("multiple_users_affected"), F.lit("single_user_affected"), F.lit("insufficient_information"), F.lit("odd")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    d, after = R.priority_decision(F.col("o_orderkey") % 7, F.col("o_custkey") % 8, (F.col("o_custkey") % 100).cast("double") / 100, F.array(reason), ["multiple_users_affected"], 0.6, 2)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), d.alias("decision"), after.alias("priority"))


@query("p04_escalation_evidence", """WITH f AS (SELECT l_orderkey, max(CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate END) AS human FROM lineitem GROUP BY l_orderkey), t AS (SELECT o_orderkey AS id, o_orderdate AS c, human, o_orderdate + INTERVAL 90 DAY AS deadline, o_custkey % 3 > 0 AS assigned FROM orders LEFT JOIN f ON l_orderkey = o_orderkey)
  SELECT id, coalesce(date_diff('microsecond', greatest(c, human), TIMESTAMP '1998-06-01') / 3600000000e0 >= 240, FALSE) AS no_human_response, NOT assigned AS unassigned, deadline <= TIMESTAMP '1998-06-01' AS sla_breached, deadline > TIMESTAMP '1998-06-01' AND deadline <= TIMESTAMP '1998-06-01' + INTERVAL 48 HOUR AS sla_at_risk FROM t""")
def p04(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").where("l_linenumber % 2 = 0").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("human"))
    t = table(spark, sf_dir, "orders").join(f, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    e = R.escalation_evidence(F.col("o_orderdate"), F.col("human"), F.col("o_orderdate") + F.expr("INTERVAL 90 DAY"), F.col("o_custkey") % 3 > 0, F.lit("1998-06-01 00:00:00").cast("timestamp_ntz"), 240, 48)
    return t.select(F.col("o_orderkey").alias("id"), *[e[k].alias(k) for k in ("no_human_response", "unassigned", "sla_breached", "sla_at_risk")])


@query("p03_escalation", """WITH t AS (SELECT o_orderkey AS id, date_diff('microsecond', o_orderdate, TIMESTAMP '1998-06-01') / 3600000000e0 AS age, o_custkey % 2 = 0 AS needs, o_custkey % 3 = 0 AS inactive, o_custkey % 5 > 0 AS esc, o_custkey % 4 AS lvl, CAST(o_custkey % 100 AS DOUBLE) / 100 AS conf, o_orderkey % 3 = 0 AS ok FROM orders)
  SELECT id, CASE WHEN NOT age >= 1000 THEN 'escalation_min_age_not_reached' WHEN needs AND NOT inactive THEN 'escalation_human_activity_recent' WHEN NOT esc THEN 'escalation_not_recommended' WHEN lvl NOT BETWEEN 1 AND 2 THEN 'escalation_level_not_allowed' WHEN conf < 0.4e0 THEN 'escalation_confidence_below_threshold' WHEN NOT ok THEN 'escalation_reason_not_allowed' ELSE 'escalation_accepted' END AS decision FROM t""")
def p03(spark, sf_dir):
    k = F.col("o_custkey")
    age = -X.age_days(F.lit("1998-06-01 00:00:00").cast("timestamp_ntz"), "1998-06-01 00:00:00") + X.age_days(F.col("o_orderdate"), "1998-06-01 00:00:00") * 24
    gates = R.escalation_gates(age, 1000, k % 2 == 0, k % 3 == 0, k % 5 > 0, k % 4, 2, (k % 100).cast("double") / 100, 0.4, F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("sla"))).otherwise(F.array(F.lit("odd"))), ["sla"])
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), R.decide(gates, "escalation_accepted").alias("decision"))


@query("p08_status_reply", """WITH t AS (SELECT event_id AS id, value / 100e0 AS rel, CAST(event_id % 100 AS DOUBLE) / 100 AS conf, event_type, user_id % 6 > 0 AS known FROM events), f AS (SELECT *, least(greatest(rel, 0e0), 1e0) * conf AS fin FROM t)
  SELECT id, CASE WHEN NOT known THEN 'status_reply_not_selected' WHEN rel < 0.3e0 THEN 'status_reply_relevance_below_threshold' WHEN conf < 0.5e0 THEN 'status_reply_confidence_below_threshold' WHEN fin < 0.4e0 THEN 'status_reply_final_below_threshold' WHEN event_type = 'view' THEN 'reply_status_maintenance_accepted' ELSE 'reply_status_incident_accepted' END AS decision, round(fin, 9) AS final FROM f""")
def p08(spark, sf_dir):
    d, final = R.status_reply(F.col("value") / 100, (F.col("event_id") % 100).cast("double") / 100, F.col("user_id") % 6 > 0, F.when(F.col("event_type") == "view", "maintenance").otherwise("incident"), 0.3, 0.5, 0.4)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), d.alias("decision"), F.round(final, 9).alias("final"))


@query("p12_publication_gate", sql("""g AS (SELECT run_id, count(*) FILTER (type = 'evidence.learned') AS e, count(DISTINCT source_id) FILTER (type LIKE 'evidence.%') AS s, count(*) FILTER (type = 'evidence.corroborated') AS c, count(DISTINCT source_id) FILTER (source_id % 10 = 0) AS a, max(seq) % 4 > 0 AS n FROM research_event GROUP BY run_id)
  SELECT run_id, CASE WHEN e < 3 THEN 'insufficient_evidence' WHEN s < 2 THEN 'insufficient_sources' WHEN c < 1 THEN 'insufficient_corroboration' WHEN a < 1 THEN 'no_authoritative_source' WHEN NOT n THEN 'no_new_information' ELSE 'publish' END AS decision FROM g""", "research_event"))
def p12(spark, sf_dir):
    t = F.col("type")
    g = views.research_event(spark, sf_dir).groupBy("run_id").agg(F.count_if(t == "evidence.learned").alias("e"), F.count_distinct(F.when(t.startswith("evidence."), F.col("source_id"))).alias("s"), F.count_if(t == "evidence.corroborated").alias("c"), F.count_distinct(F.when(F.col("source_id") % 10 == 0, F.col("source_id"))).alias("a"), (F.max("seq") % 4 > 0).alias("n"))
    return g.select("run_id", R.publication_gate(F.col("e"), F.col("s"), F.col("c"), F.col("a"), F.col("n")).alias("decision"))


@query("p13_impact_risk", """WITH g AS (SELECT l_suppkey AS id, count(*) AS n, count(DISTINCT l_returnflag) AS c, count(DISTINCT l_shipdate) % 7 AS r, count(DISTINCT l_linestatus) - 1 AS s FROM lineitem WHERE l_quantity > 45 GROUP BY l_suppkey)
  SELECT id, n AS nodes, CASE WHEN s > 1 OR c > 2 OR r > 4 OR n >= 120 THEN 'high' WHEN s > 0 OR c > 1 OR r > 0 OR n >= 35 THEN 'medium' ELSE 'low' END AS risk FROM g""")
def p13(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("n"), F.count_distinct("l_returnflag").alias("c"), (F.count_distinct("l_shipdate") % 7).alias("r"), (F.count_distinct("l_linestatus") - 1).alias("s"))
    return g.select("id", F.col("n").alias("nodes"), X.risk_class(F.col("n"), F.col("c"), F.col("r"), F.col("s")).alias("risk"))


#: What the tickets of p09 say besides their own text, in German as the rules.
SAYINGS = (
    "Meine Kollegen und ich können nicht drucken.", "Mehrere Mitarbeiter warten.", "Wir alle sind betroffen.", "Der ganzer Standort ist ohne Netz.", "Die gesamte Verwaltung steht.", "Es gibt einen Workaround.",
    "Andere Drucker im Flur funktionieren noch.", "Die Bürodrucker laufen noch.", "Es gibt keine Alternative.", "Die Frist endet heute.", "Verdacht auf Phishing.", "Dateien gelöscht!", "Ich kann nicht drucken.", "Antiphishing &amp; mehr",
)


@query("p09_ticket_signals", sql(r"""s AS (SELECT ticket_id, [""" + ", ".join(f"'{x}'" for x in SAYINGS) + r"""] AS say, coalesce(content, '') AS own FROM ticket),
  j AS (SELECT ticket_id, say[ticket_id % 14 + 1] || chr(10) || '<p>' || say[ticket_id // 14 % 14 + 1] || '</p> ' || own AS raw FROM s),
  t AS (SELECT ticket_id, trim(regexp_replace(replace(regexp_replace(regexp_replace(raw, '<br ?/?>|</p>|</li>', chr(10), 'g'), '(?s)<[^>]*>', ' ', 'g'), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM j),
  m AS (""" + " UNION ALL ".join(f"SELECT ticket_id, t, {i} AS n, '{code}' AS code, regexp_extract(t, '(?i){p}') AS hit FROM t" for i, (code, p) in enumerate(R.SIGNALS)) + """),
  f AS (SELECT *, strpos(t, hit) AS place, row_number() OVER (PARTITION BY ticket_id, code ORDER BY n) AS rn FROM m WHERE hit <> ''),
  p AS (SELECT *, greatest(place - 90, 1) AS l, place + length(hit) + 90 AS e FROM f WHERE rn = 1)
  SELECT ticket_id, code, CASE WHEN l > 1 THEN '…' ELSE '' END || trim(substring(t, l, e - l)) || CASE WHEN e <= length(t) THEN '…' ELSE '' END AS excerpt FROM p""", "ticket"))
def p09(spark, sf_dir):
    t, say = views.ticket(spark, sf_dir), F.array(*[F.lit(x) for x in SAYINGS])
    at = lambda i: F.get(say, (i % 14).cast("int"))
    content = F.concat(F.lit("<p>"), at(F.floor(F.col("ticket_id") / 14)), F.lit("</p> "), F.coalesce("content", F.lit("")))
    return R.signals(t.select("ticket_id", at(F.col("ticket_id")).alias("subject"), content.alias("content")))


@query("j09_interval_overlap", """SELECT o_orderkey AS id FROM orders WHERE coalesce(o_orderdate, o_orderdate + INTERVAL 10 DAY) <= TIMESTAMP '1995-03-20' AND coalesce(CASE WHEN o_custkey % 4 > 0 THEN o_orderdate + INTERVAL 10 DAY END, o_orderdate) >= TIMESTAMP '1995-03-01'""")
def j09(spark, sf_dir):
    start, end = F.col("o_orderdate"), F.when(F.col("o_custkey") % 4 > 0, F.col("o_orderdate") + F.expr("INTERVAL 10 DAY"))
    return table(spark, sf_dir, "orders").where(overlaps(start, end, "1995-03-01 00:00:00", "1995-03-20 00:00:00")).select(F.col("o_orderkey").alias("id"))


def overlaps(start, end, low: str, high: str):
    """[start, end] meets [low, high]; a missing end is the other one, and without both a row is kept."""
    a, b = F.coalesce(start, end), F.coalesce(end, start)
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    return a.isNull() | ((a <= at(high)) & (b >= at(low)))


@query("j05_category_mapping", """WITH o AS (SELECT source AS label, count(DISTINCT doc_id) AS n FROM documents GROUP BY source), m AS (SELECT 'src' || CAST(p_partkey AS VARCHAR) AS label, p_partkey AS category FROM part)
  SELECT coalesce(o.label, m.label) AS label, coalesce(n, 0) AS used, category, CASE WHEN n IS NULL THEN 'orphan' WHEN category IS NULL THEN 'unmapped' ELSE 'mapped' END AS state FROM o FULL JOIN m ON o.label = m.label""")
def j05(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array("source").alias("labels"))
    label = F.concat(F.lit("src"), F.col("p_partkey").cast("string"))
    told = table(spark, sf_dir, "part").select(label.alias("normalized"), label.alias("label"), F.array("p_partkey").alias("ids"))
    return K.mapping_usage(docs, told).select("label", "used", F.get("ids", 0).alias("category"), "state")


@query("j07_not_yet_queued", sql("""q AS (SELECT DISTINCT id % 500 AS m FROM job WHERE status IN ('queued', 'claimed') AND type = 'vector.relink') SELECT id, created_at FROM memory WHERE status = 'active' AND id NOT IN (SELECT m FROM q) ORDER BY created_at, id LIMIT 64""", "memory", "job"))
def j07(spark, sf_dir):
    jobs = views.job(spark, sf_dir).where("type = 'vector.relink'").select(F.expr("id % 500").alias("id"), "status")
    return J.not_queued(views.memory(spark, sf_dir).where("status = 'active'").select("id", "created_at"), jobs, 64)


@query("j03_effective_category", """SELECT o_orderkey AS id, coalesce(n_name, 'Kategorie #' || CAST(o_custkey % 40 AS VARCHAR)) AS category FROM orders LEFT JOIN nation ON n_nationkey = o_custkey % 40""")
def j03(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr("o_custkey % 40").alias("category_id"))
    return K.effective_category(o, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).select("id", "category")


@query("f08_research_relevance", sql(r"""w AS (SELECT id, regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+') AS w FROM kdoc), p AS (SELECT id, list_filter(w, lambda t: t <> '') AS w FROM w), b AS (SELECT id, w, list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || w[i + 1]), list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || w[i + 1] || w[i + 2])) AS n FROM p)
  SELECT id, len(list_intersect(['thethe', 'thewas', 'that'], list_distinct(n))) >= 2 AS relevant FROM b""", "kdoc"))
def f08(spark, sf_dir):
    return views.kdoc(spark, sf_dir).select("id", T.material_relevant(T.strings("thethe", "thewas", "that"), F.col("text")).alias("relevant"))


@query("c23_goal_anchors", r"""WITH w AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+'), lambda t: length(t) >= 3))) AS word, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+'), lambda t: length(t) >= 3) AS ws FROM benchmark),
  r AS (SELECT item_id, word, row_number() OVER (PARTITION BY item_id ORDER BY strlen(word) DESC, list_position(ws, word)) AS n FROM w) SELECT item_id, array_to_string(list(word ORDER BY n), ' ') AS anchors FROM r WHERE n <= 6 GROUP BY item_id""")
def c23(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.goal_anchors(F.col("text")), " ").alias("anchors"))


@query("f13_worker_job_match", sql("""w AS (SELECT 'w' || CAST(i AS VARCHAR) AS worker, CASE WHEN i % 2 = 0 THEN 'cpu' ELSE 'gpu' END AS resource, CASE WHEN i < 3 THEN ['model.chat'] ELSE ['model.chat', 'model.embed'] END AS caps FROM range(6) t(i))
  SELECT w.worker, count(*) AS jobs FROM job j JOIN w ON w.resource = j.resource AND list_contains(w.caps, j.type) WHERE j.status = 'queued' GROUP BY w.worker""", "job"))
def f13(spark, sf_dir):
    from recallbase.operators.jobs import worker_matches

    w = spark.createDataFrame([(f"w{i}", "gpu" if i % 2 else "cpu", ["model.chat"] if i < 3 else ["model.chat", "model.embed"]) for i in range(6)], "worker string, w_resource string, caps array<string>")
    kinds = views.job(spark, sf_dir).where("status = 'queued'").groupBy("resource", "type").agg(F.count("*").alias("n"))
    return kinds.join(F.broadcast(w), worker_matches(F.col("w_resource"), F.col("caps"), F.col("resource"), F.array("type"))).groupBy("worker").agg(F.sum("n").alias("jobs"))


@query("f05_metadata_find", sql("SELECT id, title FROM kdoc WHERE contains(lower(CAST(id AS VARCHAR) || ' ' || title), 'the') ORDER BY id LIMIT 30", "kdoc"))
def f05(spark, sf_dir):
    return views.kdoc(spark, sf_dir).where(F.lower(F.concat_ws(" ", F.col("id").cast("string"), "title")).contains("the")).select("id", "title").orderBy("id").limit(30)


@query("d04_manifest_delta", """WITH o AS (SELECT doc_id AS path, md5(text) AS h FROM documents WHERE doc_id % 10 <> 3), n AS (SELECT doc_id AS path, md5(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 4)
  SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN o.h = n.h THEN 'reused' ELSE 'changed' END AS state FROM o FULL JOIN n ON o.path = n.path""")
def d04(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    old = d.where("doc_id % 10 <> 3").select(F.col("doc_id").alias("path"), F.md5("text").alias("hash"))
    new = d.where("doc_id % 10 <> 4").select(F.col("doc_id").alias("path"), F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    return delta(old, new)


def delta(old, new):
    """path, state (`added`, `changed`, `deleted`, `reused`) of two manifests (path, hash)."""
    j = old.select("path", F.col("hash").alias("a"), F.lit(1).alias("ia")).join(new.select("path", F.col("hash").alias("b"), F.lit(1).alias("ib")), "path", "full")
    return j.select("path", F.when(F.col("ia").isNull(), "added").when(F.col("ib").isNull(), "deleted").when(F.col("a").eqNullSafe(F.col("b")), "reused").otherwise("changed").alias("state"))


@query("d05_replace_source", """SELECT source, count(*) AS n FROM (SELECT source FROM documents WHERE source <> 'src1' UNION ALL SELECT 'src1' FROM pages WHERE page_id % 3 = 0) GROUP BY source""")
def d05(spark, sf_dir):
    old = table(spark, sf_dir, "documents").select("doc_id", "source")
    new = table(spark, sf_dir, "pages").where("page_id % 3 = 0").select(F.col("page_id").alias("doc_id"), F.lit("src1").alias("source"))
    replaced = old.join(small(new.select("source").distinct()), "source", "left_anti").unionByName(new)
    return replaced.groupBy("source").agg(F.count("*").alias("n"))


@query("d06_layered_override", """SELECT coalesce(l.doc_id, d.doc_id) AS id, CASE WHEN l.doc_id IS NULL THEN 'static' ELSE 'managed' END AS layer FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id""")
def d06(spark, sf_dir):
    static = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("static").alias("layer"), F.lit(0).alias("p"))
    managed = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit("managed").alias("layer"), F.lit(1).alias("p"))
    return static.union(managed).groupBy("id").agg(F.max_by("layer", "p").alias("layer"))


@query("d10_fingerprint_unique", r"""WITH f AS (SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS fp FROM documents) SELECT fp, count(*) AS n, min(doc_id) AS first FROM f GROUP BY fp HAVING count(*) > 1""")
def d10(spark, sf_dir):
    f = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), 256).alias("fp"))
    return f.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query("d08_identifier_containment", r"""WITH i AS (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '(?i)\b(?:0x[0-9a-f]{4,}|cve-\d{4}-\d{4,}|kb\d{5,}|v?\d+\.\d+(?:\.\d+){0,2})\b|-\d{3,}'), lambda t: lower(t)))) AS token FROM documents) SELECT doc_id, token FROM i WHERE token <> '2.0'""")
def d08(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.critical_identifiers(F.col("text"))).alias("token"))
    return found.where(~F.lit("licensed under the apache license, version 2.0").contains(F.col("token")) | (F.col("token") != "2.0"))


@query("c06_word_chunks", r"""WITH p AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') AS w FROM documents), n AS (SELECT doc_id, w, CASE WHEN len(w) <= 160 THEN 1 ELSE CAST(ceil((len(w) - 160) / 130e0) AS INTEGER) + 1 END AS n FROM p WHERE len(w) > 0),
  c AS (SELECT doc_id, unnest(list_transform(generate_series(0, n - 1), lambda i: array_to_string(w[i * 130 + 1 : i * 130 + 160], ' '))) AS chunk FROM n) SELECT doc_id, count(*) AS chunks, sum(length(chunk)) AS chars, min(md5(chunk)) AS least FROM c GROUP BY doc_id""")
def c06(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.chunk_words(F.col("text"))).alias("chunk"))
    return c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk")).alias("chars"), F.min(F.md5("chunk")).alias("least"))


@query("c32_content_hashes", "SELECT doc_id, sha256(text) AS text_hash, 'src_' || substring(sha256(source), 1, 12) AS source_key, sha256(CAST(doc_id AS VARCHAR) || chr(1) || lang || chr(1) || text) AS doc_hash FROM documents")
def c32(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash"), F.concat(F.lit("src_"), F.substring(F.sha2("source", 256), 1, 12)).alias("source_key"), F.sha2(F.concat_ws(chr(1), F.col("doc_id").cast("string"), "lang", "text"), 256).alias("doc_hash"))


@query("c05_stems", sql(r"""w AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+'), lambda t: length(t) >= 3)) AS word FROM kdoc WHERE language = 'de')
  SELECT word, """ + "CASE " + " ".join(f"WHEN ends_with(word, '{s}') AND strlen(word) - {len(s)} >= 5 THEN substring(word, 1, length(word) - {len(s)})" for s in T.SUFFIXES) + " ELSE word END AS stem FROM w", "kdoc"))
def c05(spark, sf_dir):
    w = views.kdoc(spark, sf_dir).where("language = 'de'").select(F.explode(F.filter(T.research_words(F.col("text")), lambda t: F.length(t) >= 3)).alias("word")).distinct()
    return w.select("word", T.stem(F.col("word")).alias("stem"))


@query("c30_token_estimate", "SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents")
def c30(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("c13_slug", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def c13(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"))


@query("c12_excerpt", r"WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 120 THEN substring(t, 1, 120) || '…' ELSE t END AS excerpt FROM f")
def c12(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text"), 120).alias("excerpt"))


@query("c10_strip_tags", "SELECT page_id, sha256(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '<[^>]*$', '')) AS stripped FROM pages")
def c10(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(T.strip_tags(F.col("html")), 256).alias("stripped"))


@query("w01_candidate_audit", sql("""r AS (SELECT label, id, round(salience, 9) AS score, CAST(row_number() OVER (PARTITION BY label ORDER BY salience DESC, id) AS INTEGER) AS rank, greatest(0.8e0, confidence) AS required FROM memory)
  SELECT label, id, score, rank, round(required, 9) AS required, CASE WHEN score < 0.7e0 THEN 'below_retrieval_floor' WHEN rank > 5 THEN 'max_candidates_reached' ELSE 'sent_to_ai' END AS reason FROM r WHERE rank <= 15""", "memory"))
def w01(spark, sf_dir):
    w = Window.partitionBy("label").orderBy(F.desc("salience"), "id")
    r = views.memory(spark, sf_dir).select("label", "id", F.round("salience", 9).alias("score"), F.row_number().over(w).alias("rank"), F.round(F.greatest(F.lit(0.8), "confidence"), 9).alias("required")).where("rank <= 15")
    return r.withColumn("reason", F.when(F.col("score") < 0.7, "below_retrieval_floor").when(F.col("rank") > 5, "max_candidates_reached").otherwise("sent_to_ai"))


@query("w06_last_human_turn", """WITH r AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'user') SELECT conv_id, turn, size FROM r WHERE n = 1""")
def w06(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by(F.length("text").cast("long"), "turn").alias("size"))
    return c.select("conv_id", "turn", "size")


def _rendezvous_sql(rows: str, weights: dict[str, float]) -> str:
    """id and target of rows (id): the shard of the largest weight / -ln(u), the first among equals."""
    parts = " UNION ALL ".join(f"SELECT id, {i} AS n, '{name}' AS shard, {weight} AS weight, CAST(id AS VARCHAR) || chr(0) || '{name}' AS k FROM ({rows})" for i, (name, weight) in enumerate(weights.items()))
    return f"""WITH a AS ({parts}), b AS (SELECT *, {hash_sql.fnv1a("k")} AS h FROM a), s AS (SELECT *, weight / -ln({hash_sql.unit("h")}) AS score FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, n) AS rn FROM s)
  SELECT id, shard AS target FROM r WHERE rn = 1"""


@query("c33_rendezvous_shard", "SELECT id AS doc_id, target AS shard FROM (" + _rendezvous_sql("SELECT DISTINCT doc_id AS id FROM documents", {"alpha": 1.0, "beta": 1.0, "gamma": 2.0}) + ")")
def c33(spark, sf_dir):
    from recallbase.functions.hashes import rendezvous

    return table(spark, sf_dir, "documents").select("doc_id", rendezvous(["alpha", "beta", "gamma"], [1.0, 1.0, 2.0])(F.col("doc_id").cast("string")).alias("shard"))


@query("v11_hnsw_levels", f"WITH a AS (SELECT CAST(vec_id AS VARCHAR) AS k FROM embeddings), b AS (SELECT {hash_sql.fnv1a('k')} AS h FROM a) SELECT CAST(least(floor(-ln({hash_sql.unit('h')})), 32) AS INTEGER) AS level, count(*) AS n FROM b GROUP BY 1")
def v11(spark, sf_dir):
    from recallbase.functions.hashes import hnsw_level

    return table(spark, sf_dir, "embeddings").select("vec_id", hnsw_level(F.col("vec_id").cast("string")).alias("level")).groupBy("level").agg(F.count("*").alias("n"))


@query("c34_fnv_ids", f"WITH a AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS k FROM documents) SELECT doc_id, printf('%016x', {hash_sql.fnv1a('k')}) AS h FROM a")
def c34(spark, sf_dir):
    from recallbase.functions.hashes import fnv1a_hex

    return table(spark, sf_dir, "documents").select("doc_id", fnv1a_hex(F.col("doc_id").cast("string")).alias("h"))


@query("v23_vector_fingerprint")
def v23(spark, sf_dir):
    from recallbase.functions.hashes import vector_fingerprint

    return table(spark, sf_dir, "embeddings").select("vec_id", vector_fingerprint(F.col("embedding")).alias("fingerprint"))
