"""Summaries, dashboards, queues and costs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recallbase.functions import exprs as X
from recallbase.functions import text as T
from recallbase.operators import aggregates as A
from recallbase.operators import jobs as J
from recallbase.operators.budget import reserve
from recallbase.operators.shared import in_blocks, small
from recallbase.plans import views
from recallbase.plans.registry import query
from recallbase.plans.views import sql
from recallbase.session import table


@query("a01_knowledge_summary", sql("""SELECT CASE WHEN grouping(memory_type) = 0 THEN 'memory_type' WHEN grouping(status) = 0 THEN 'status' WHEN grouping(kind) = 0 THEN 'kind' ELSE 'source' END AS dimension,
  coalesce(memory_type, status, kind, source) AS value, count(*) AS n FROM memory GROUP BY GROUPING SETS ((memory_type), (status), (kind), (source))""", "memory"))
def a01(spark, sf_dir):
    return A.counts_by(views.memory(spark, sf_dir), "memory_type", "status", "kind", "source")


@query("a01_knowledge_totals", sql("""SELECT count(*) AS memories, count(DISTINCT lower(truth_key)) AS truth_keys, count(*) FILTER (status = 'conflicted') AS conflicts,
  round(avg(CASE WHEN confidence > 0 THEN confidence END), 9) AS avg_confidence, round(avg(reward), 9) AS avg_reward FROM memory""", "memory"))
def a01_totals(spark, sf_dir):
    m = views.memory(spark, sf_dir)
    return m.agg(F.count("*").alias("memories"), F.count_distinct(F.lower("truth_key")).alias("truth_keys"), F.count_if(F.col("status") == "conflicted").alias("conflicts"), F.round(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), 9).alias("avg_confidence"), F.round(F.avg("reward"), 9).alias("avg_reward"))


@query("a02_top_tags", r"""WITH w AS (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+'), lambda t: length(t) >= 6)) AS tag FROM documents)
  SELECT tag, count(*) AS n FROM w GROUP BY tag ORDER BY n DESC, tag LIMIT 20""")
def a02(spark, sf_dir):
    tags = table(spark, sf_dir, "documents").select(F.explode(F.filter(T.research_words(F.col("text")), lambda t: F.length(t) >= 6)).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(20)


@query("a05_facets", """WITH p AS (SELECT 'language' AS facet, lang AS name FROM documents UNION ALL SELECT 'source', source FROM documents UNION ALL SELECT 'role', role FROM conversations),
  c AS (SELECT facet, name, count(*) AS n FROM p WHERE trim(name) <> '' GROUP BY facet, name), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY facet ORDER BY n DESC, lower(name), name) AS INTEGER) AS rank FROM c)
  SELECT facet, name, n, rank FROM r WHERE rank <= 8""")
def a05(spark, sf_dir):
    d, c = table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations")
    return A.facets([("language", d.select(F.col("lang").alias("name"))), ("source", d.select(F.col("source").alias("name"))), ("role", c.select(F.col("role").alias("name")))])


@query("a08_research_run_stats", sql("""SELECT run_id, count(*) FILTER (type = 'search.result') AS results, count(*) FILTER (type = 'download.started') AS downloads_started, count(*) FILTER (type = 'download.completed') AS downloads_completed,
  count(*) FILTER (type = 'claim.extracted') AS claims, count(*) FILTER (type = 'evidence.learned') AS new_evidence, count(*) FILTER (type IN ('evidence.duplicate', 'source.duplicate', 'evidence.corroborated')) AS duplicates,
  count(*) FILTER (type = 'evidence.corroborated') AS corroborations, count(*) FILTER (type = 'source.rejected') AS rejected_sources, count(*) FILTER (type = 'evidence.skipped') AS skipped_evidence,
  count(*) FILTER (status = 'error') AS errors, max(seq) AS last_seq, max(CASE WHEN status = 'error' THEN seq END) AS last_error_seq, max(created_at) AS updated_at FROM research_event GROUP BY run_id""", "research_event"))
def a08(spark, sf_dir):
    return A.run_stats(views.research_event(spark, sf_dir))


@query("a10_usage_totals", sql("""priced AS (SELECT created_at, CAST(input_tokens AS DOUBLE) / 1e6 * 2e0 AS cost FROM usage)
  SELECT round(sum(CASE WHEN date_trunc('day', created_at) = TIMESTAMP '1996-03-15' THEN cost ELSE 0e0 END), 6) AS daily, round(sum(CASE WHEN date_trunc('month', created_at) = TIMESTAMP '1996-03-01' THEN cost ELSE 0e0 END), 6) AS monthly FROM priced""", "usage"))
def a10(spark, sf_dir):
    u = views.usage(spark, sf_dir).select("created_at", (F.col("input_tokens") / 1e6 * 2.0).alias("cost"))
    return A.usage_totals(u, "1996-03-15 10:00:00").select(F.round("daily", 6).alias("daily"), F.round("monthly", 6).alias("monthly"))


_PRICES = [("model-NO", 2.0, 0.5, 8.0, 0.1, 30_000, 4.0, 0.0, 12.0), ("model-RF", 1.0, 0.0, 4.0, 0.0, 0, 0.0, 0.0, 0.0), ("model-AF", 3.0, 1.0, 9.0, 0.2, 40_000, 0.0, 2.0, 0.0)]
_PRICE_SQL = "prices(model, input, cached, output, embedding, long_from, long_input, long_cached, long_output) AS (VALUES " + ", ".join("('{}', {}e0, {}e0, {}e0, {}e0, {}, {}e0, {}e0, {}e0)".format(*p) for p in _PRICES) + ")"


@query("a27_actual_cost", sql(_PRICE_SQL + """, r AS (SELECT u.*, CASE WHEN long_from > 0 AND input_tokens > long_from AND long_input > 0 THEN long_input ELSE input END AS ri, CASE WHEN long_from > 0 AND input_tokens > long_from AND long_cached > 0 THEN long_cached ELSE cached END AS rc,
    CASE WHEN long_from > 0 AND input_tokens > long_from AND long_output > 0 THEN long_output ELSE output END AS ro, CASE WHEN embedding = 0 THEN input ELSE embedding END AS re FROM usage u JOIN prices USING (model)),
  c AS (SELECT model, category, CASE WHEN category = 'embedding' THEN input_tokens / 1e6 * re ELSE greatest(input_tokens - cached_tokens, 0) / 1e6 * ri + cached_tokens / 1e6 * CASE WHEN rc = 0 THEN ri ELSE rc END + output_tokens / 1e6 * ro END AS cost FROM r)
  SELECT model, category, count(*) AS n, round(sum(cost), 4) AS cost FROM c GROUP BY model, category""", "usage"))
def a27(spark, sf_dir):
    """a27, c31: rates by tier, long contexts and cached tokens at their own."""
    prices = spark.createDataFrame(_PRICES, "model string, input double, cached double, output double, embedding double, long_from long, long_input double, long_cached double, long_output double")
    return A.cost(views.usage(spark, sf_dir), prices).groupBy("model", "category").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 4).alias("cost"))


def _hist_sql(keys: str) -> str:
    p95 = " ".join(f"WHEN b{i} >= ceil(requests * 0.95e0) THEN {b * 1000!r}e0" for i, b in enumerate(A.DURATIONS))
    b = ", ".join(f"count(*) FILTER (seconds <= {b!r}e0) AS b{i}" for i, b in enumerate(A.DURATIONS))
    return f"""g AS (SELECT {keys}, count(*) AS requests, count(*) FILTER (code >= 400) AS errors, CAST(sum(bytes) AS BIGINT) AS bytes, round(avg(seconds) * 1000, 6) AS avg_ms, {b} FROM http_request GROUP BY {keys})
      SELECT {keys}, requests, errors, bytes, avg_ms, CASE {p95} ELSE {A.DURATIONS[-1] * 1000!r}e0 END AS p95_ms FROM g"""


@query("a14_route_dashboard", sql(_hist_sql("method, route") + " ORDER BY requests DESC, route, method LIMIT 20", "http_request"))
def a14(spark, sf_dir):
    return A.http_histogram(views.http_request(spark, sf_dir), "method", "route").withColumn("avg_ms", F.round("avg_ms", 6)).orderBy(F.desc("requests"), "route", "method").limit(20)


@query("a13_http_metrics", sql(_hist_sql("method, route, code"), "http_request"))
def a13(spark, sf_dir):
    """a13, a15: sums and the p95 of a histogram per method, route and code."""
    return A.http_histogram(views.http_request(spark, sf_dir), "method", "route", "code").withColumn("avg_ms", F.round("avg_ms", 6))


@query("a16_nearest_rank_percentile", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def a16(spark, sf_dir):
    return A.nearest_rank(table(spark, sf_dir, "events"), "event_type", "value", p50=0.5, p95=0.95, p99=0.99)


@query("a17_quality_replay", """WITH s AS (SELECT item_id AS case_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY length(d.text), doc_id) AS rank, count(*) OVER (PARTITION BY item_id) AS n FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
  e AS (SELECT b.item_id AS case_id, (SELECT min(rank) FROM s WHERE s.case_id = b.item_id AND s.doc_id % 2 = 0) AS rank FROM benchmark b)
  SELECT count(*) AS cases, round(avg(CASE WHEN rank <= 5 THEN 1e0 ELSE 0e0 END), 9) AS recall_at_k, round(avg(CASE WHEN rank <= 5 THEN 1e0 / rank ELSE 0e0 END), 9) AS mrr FROM e""")
def a17(spark, sf_dir):
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    cases = b.select(F.col("item_id").alias("case_id"), F.col("text").alias("wanted"))  # a stated set
    hits = in_blocks(cases, "case_id", lambda block: d.join(block, F.col("text").contains(F.col("wanted")))).select("case_id", "doc_id", F.length("text").alias("size"))
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("size", "doc_id"))).where("doc_id % 2 = 0").groupBy("case_id").agg(F.min("rank").alias("rank"))
    out = A.reciprocal_rank(b.select(F.col("item_id").alias("case_id")).join(ranked, "case_id", "left"), 5)
    return out.select("cases", F.round("recall_at_k", 9).alias("recall_at_k"), F.round("mrr", 9).alias("mrr"))


@query("a18_goal_progress", sql("""e AS (SELECT goal_id, count(DISTINCT memory_id) AS evidence, count(DISTINCT source_id) AS sources, count(DISTINCT CASE WHEN type = 'evidence.corroborated' THEN memory_id * 1000 + source_id END) AS corroborations
    FROM research_event WHERE type IN ('evidence.learned', 'evidence.corroborated') GROUP BY goal_id)
  SELECT goal_id, evidence, sources, corroborations, round(least(1e0, 0.55e0 * least(1e0, evidence / 20e0) + 0.25e0 * least(1e0, sources / 8e0) + 0.15e0 * least(1e0, corroborations / 5e0) + 0.05e0 * 0.5e0), 9) AS progress FROM e""", "research_event"))
def a18(spark, sf_dir):
    e = views.research_event(spark, sf_dir).where(F.col("type").isin("evidence.learned", "evidence.corroborated"))
    g = e.groupBy("goal_id").agg(F.count_distinct("memory_id").alias("evidence"), F.count_distinct("source_id").alias("sources"), F.count_distinct(F.when(F.col("type") == "evidence.corroborated", F.struct("memory_id", "source_id"))).alias("corroborations"))
    return g.select("goal_id", "evidence", "sources", "corroborations", F.round(A.goal_progress(F.col("evidence"), F.col("sources"), F.col("corroborations"), F.lit(0.0)), 9).alias("progress"))


@query("a11_orchestrator_status", sql("""SELECT CASE WHEN grouping(status) = 0 THEN 'status' WHEN grouping(type) = 0 THEN 'type' ELSE 'resource' END AS dimension, coalesce(status, type, resource) AS value, count(*) AS n FROM job GROUP BY GROUPING SETS ((status), (type), (resource))""", "job"))
def a11(spark, sf_dir):
    return A.counts_by(views.job(spark, sf_dir), "status", "type", "resource")


@query("a11_payload_totals", sql("""SELECT CAST(sum(CASE WHEN status IN ('done', 'failed') THEN 0 ELSE payload_bytes END) AS BIGINT) AS pending_bytes, CAST(sum(CASE WHEN status IN ('done', 'failed') THEN payload_bytes ELSE 0 END) AS BIGINT) AS terminal_bytes,
  min(CASE WHEN status = 'queued' THEN created_at END) AS oldest_queued, count(*) FILTER (status NOT IN ('done', 'failed') AND type = 'model.embed') AS pending_embeds FROM job""", "job"))
def a11_payload(spark, sf_dir):
    j, over = views.job(spark, sf_dir), F.col("status").isin(*J.TERMINAL)
    return j.agg(F.sum(F.when(over, 0).otherwise(F.col("payload_bytes"))).alias("pending_bytes"), F.sum(F.when(over, F.col("payload_bytes")).otherwise(0)).alias("terminal_bytes"), F.min(F.when(F.col("status") == "queued", F.col("created_at"))).alias("oldest_queued"), F.count_if(~over & (F.col("type") == "model.embed")).alias("pending_embeds"))


@query("l08_jobs_listing", sql("SELECT id, type, status, priority, created_at FROM job WHERE status = 'queued' AND type = 'vector.relink' ORDER BY created_at DESC, id LIMIT 500", "job"))
def l08(spark, sf_dir):
    return views.job(spark, sf_dir).where("status = 'queued' AND type = 'vector.relink'").select("id", "type", "status", "priority", "created_at").orderBy(F.desc("created_at"), "id").limit(500)


@query("l14_pending_master_apply", sql("SELECT id, priority, created_at FROM job WHERE status = 'apply_wait' ORDER BY priority DESC, created_at, id LIMIT 64", "job"))
def l14(spark, sf_dir):
    return views.job(spark, sf_dir).where("status = 'apply_wait'").select("id", "priority", "created_at").orderBy(F.desc("priority"), "created_at", "id").limit(64)


@query("t03_state_normalisation", sql("""n AS (SELECT id, status, CASE WHEN status = 'claimed' AND created_at + to_hours(lease_hours) < TIMESTAMP '1998-01-01' THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'retry_wait' END
    WHEN status = 'retry_wait' AND (attempts = 0 OR created_at + to_hours(1) <= TIMESTAMP '1998-01-01') THEN 'queued' ELSE status END AS new_status FROM job)
  SELECT id, new_status FROM n WHERE new_status <> status""", "job"))
def t03(spark, sf_dir):
    j = views.job(spark, sf_dir).withColumn("lease_until", F.col("created_at") + F.make_dt_interval(hours=F.col("lease_hours"))).withColumn("next_attempt_at", F.when(F.col("attempts") > 0, F.col("created_at") + F.expr("INTERVAL 1 HOUR")))
    return J.normalize(j, F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")).where("new_status <> status").select("id", "new_status")


@query("t02_claim_job", sql("""f AS (SELECT *, row_number() OVER (PARTITION BY resource ORDER BY priority DESC, created_at, id) AS n FROM job WHERE status = 'queued'), w AS (SELECT DISTINCT worker, resource FROM job)
  SELECT w.worker, w.resource, f.id, f.priority FROM w JOIN f ON f.resource = w.resource AND f.n = 1""", "job"))
def t02(spark, sf_dir):
    j = views.job(spark, sf_dir)
    return J.claims(j, j.select("worker", "resource").distinct()).select("worker", "resource", "id", "priority")


@query("j06_dependency_state", sql("""d AS (SELECT id, id - (id % 7) AS dep FROM job WHERE id % 5 = 0 AND id % 7 > 0 UNION SELECT id, id - 1 FROM job WHERE id % 5 = 0),
  s AS (SELECT d.id, j.status FROM d LEFT JOIN job j ON j.id = d.dep)
  SELECT id, CASE WHEN bool_or(status IS NULL OR status IN ('failed', 'error', 'canceled')) THEN 'failed' WHEN bool_and(status IN ('done', 'completed')) THEN 'ready' ELSE 'wait' END AS state FROM s GROUP BY id""", "job"))
def j06(spark, sf_dir):
    j = views.job(spark, sf_dir)
    five = j.where("id % 5 = 0").select("id")
    deps = five.where("id % 7 > 0").select("id", F.expr("id - id % 7").alias("depends_on")).union(five.select("id", F.expr("id - 1"))).distinct()
    return J.dependency_state(j, deps)


@query("t07_prune_terminal_jobs", sql("""d AS (SELECT DISTINCT id - 1 AS id FROM job WHERE id % 5 = 0), f AS (SELECT * FROM job WHERE status IN ('done', 'failed') AND id NOT IN (SELECT id FROM d)),
  o AS (SELECT id, 'retention' AS reason FROM f WHERE created_at < TIMESTAMP '1993-01-01'), l AS (SELECT *, row_number() OVER (ORDER BY created_at, id) AS n, count(*) OVER () AS c FROM f WHERE created_at >= TIMESTAMP '1993-01-01')
  SELECT * FROM o UNION ALL SELECT id, 'cap' FROM l WHERE n <= c - 500""", "job"))
def t07(spark, sf_dir):
    j = views.job(spark, sf_dir)
    deps = j.where("id % 5 = 0").select("id", F.expr("id - 1").alias("depends_on"))
    return J.prunable(j, deps, F.lit("1993-01-01 00:00:00").cast("timestamp_ntz"), 500)


@query("t08_worker_liveness", sql("""SELECT worker, count(*) FILTER (status = 'claimed' AND created_at + to_hours(lease_hours) >= TIMESTAMP '1995-06-01') AS in_flight, CASE WHEN max(created_at) < TIMESTAMP '1998-08-01' THEN 'stale' ELSE 'online' END AS state FROM job GROUP BY worker""", "job"))
def t08(spark, sf_dir):
    now = F.lit("1995-06-01 00:00:00").cast("timestamp_ntz")
    held = (F.col("status") == "claimed") & (F.col("created_at") + F.make_dt_interval(hours=F.col("lease_hours")) >= now)
    return views.job(spark, sf_dir).groupBy("worker").agg(F.count_if(held).alias("in_flight"), F.when(F.max("created_at") < F.lit("1998-08-01 00:00:00").cast("timestamp_ntz"), "stale").otherwise("online").alias("state"))


@query("t19_budget_reservation", "WITH RECURSIVE " + sql("""c AS (SELECT id, input_tokens AS cost, date_trunc('day', created_at) AS day, date_trunc('month', created_at) AS month, row_number() OVER (PARTITION BY date_trunc('month', created_at) ORDER BY created_at, id, input_tokens) AS k FROM usage WHERE model = 'model-NO'),
  r AS (
    SELECT month, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS id, CAST(NULL AS TIMESTAMP) AS day, CAST(0 AS HUGEINT) AS of_day, CAST(0 AS HUGEINT) AS of_month, false AS granted FROM c GROUP BY month
    UNION ALL
    SELECT month, k, id, day, spent + CASE WHEN fits THEN cost ELSE 0 END, of_month + CASE WHEN fits THEN cost ELSE 0 END, fits
    FROM (SELECT c.*, r.of_month, CASE WHEN r.day = c.day THEN r.of_day ELSE 0 END AS spent, c.cost <= 0 OR (CASE WHEN r.day = c.day THEN r.of_day ELSE 0 END + c.cost <= 120000 AND r.of_month + c.cost <= 2000000) AS fits FROM r JOIN c ON c.month = r.month AND c.k = r.k + 1))
  SELECT id, granted FROM r WHERE k > 0""", "usage")[5:])
def t19(spark, sf_dir):
    """Requests in order under a daily and a monthly budget; a refused one uses nothing."""
    u = views.usage(spark, sf_dir).where("model = 'model-NO'").select("id", F.col("created_at").alias("at"), F.col("input_tokens").alias("cost"))
    return reserve(u, 120_000, 2_000_000)


@query("w02_latest_run_per_key", sql("""r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY created_at DESC, seq DESC) AS n FROM research_event WHERE type <> 'source.rejected') SELECT run_id, seq, type, created_at FROM r WHERE n = 1""", "research_event"))
def w02(spark, sf_dir):
    e = views.research_event(spark, sf_dir).where("type <> 'source.rejected'")
    return e.groupBy("run_id").agg(F.max_by(F.struct("seq", "type", "created_at"), F.struct("created_at", "seq")).alias("m")).select("run_id", "m.seq", "m.type", "m.created_at")


@query("w09_latest_run_per_goal", sql("""r AS (SELECT goal_id, run_id, min(created_at) AS started FROM research_event GROUP BY goal_id, run_id), n AS (SELECT *, row_number() OVER (PARTITION BY goal_id ORDER BY started DESC, run_id) AS n FROM r) SELECT goal_id, run_id, started FROM n WHERE n = 1""", "research_event"))
def w09(spark, sf_dir):
    r = views.research_event(spark, sf_dir).groupBy("goal_id", "run_id").agg(F.min("created_at").alias("started"))
    return r.groupBy("goal_id").agg(F.max_by("run_id", F.struct("started", -F.col("run_id"))).alias("run_id"), F.max("started").alias("started"))


@query("w10_ring_buffer", sql("SELECT seq, run_id, type FROM research_event ORDER BY seq DESC LIMIT 600", "research_event"))
def w10(spark, sf_dir):
    return views.research_event(spark, sf_dir).select("seq", "run_id", "type").orderBy(F.desc("seq")).limit(600)


@query("w11_event_delta", sql("SELECT seq, run_id, type FROM research_event WHERE seq > 9000", "research_event"))
def w11(spark, sf_dir):
    return views.research_event(spark, sf_dir).where("seq > 9000").select("seq", "run_id", "type")


@query("l02_keyset_page", sql("SELECT id, kind, created_at FROM memory WHERE kind = 'kind-1' AND created_at < TIMESTAMP '2024-01-20' ORDER BY created_at DESC, id LIMIT 25", "memory"))
def l02(spark, sf_dir):
    return views.memory(spark, sf_dir).where((F.col("kind") == "kind-1") & (F.col("created_at") < F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))).select("id", "kind", "created_at").orderBy(F.desc("created_at"), "id").limit(25)


@query("l01_article_page", sql("SELECT id, title, language FROM kdoc WHERE lower(language) = 'en' AND contains(lower(text), 'the') AND auto_reply ORDER BY id LIMIT 50 OFFSET 50", "kdoc"))
def l01(spark, sf_dir):
    return views.kdoc(spark, sf_dir).where("lower(language) = 'en' AND contains(lower(text), 'the') AND auto_reply").select("id", "title", "language").orderBy("id").offset(50).limit(50)


@query("l11_recent_usage", sql("SELECT id, model, created_at FROM usage ORDER BY created_at DESC, id DESC LIMIT 100", "usage"))
def l11(spark, sf_dir):
    return views.usage(spark, sf_dir).select("id", "model", "created_at").orderBy(F.desc("created_at"), F.desc("id")).limit(100)


@query("l09_research_runs", sql("SELECT run_id, count(*) AS events, min(created_at) AS started FROM research_event WHERE goal_id = 3 GROUP BY run_id ORDER BY started DESC, run_id LIMIT 10", "research_event"))
def l09(spark, sf_dir):
    return views.research_event(spark, sf_dir).where("goal_id = 3").groupBy("run_id").agg(F.count("*").alias("events"), F.min("created_at").alias("started")).orderBy(F.desc("started"), "run_id").limit(10)


@query("a21_conflict_groups", sql("SELECT truth_key, id, count(*) OVER (PARTITION BY truth_key) AS n FROM memory WHERE status = 'conflicted'", "memory"))
def a21(spark, sf_dir):
    """Every memory of a conflict with the size of its group, however large that is."""
    m = views.memory(spark, sf_dir).where("status = 'conflicted'").select("truth_key", "id")
    return m.join(small(m.groupBy("truth_key").agg(F.count("*").alias("n"))), "truth_key")


@query("a25_tombstone_ratio", sql("SELECT count(*) FILTER (status <> 'archived') AS live, count(*) FILTER (status = 'archived') AS tombstones, round(count(*) FILTER (status = 'archived') / CAST(nullif(count(*), 0) AS DOUBLE), 9) AS ratio FROM memory", "memory"))
def a25(spark, sf_dir):
    gone = F.col("status") == "archived"
    return views.memory(spark, sf_dir).agg(F.count_if(~gone).alias("live"), F.count_if(gone).alias("tombstones"), F.round(F.count_if(gone) / F.nullif(F.count("*"), F.lit(0)), 9).alias("ratio"))


@query("a24_auto_reply_counts", sql("SELECT count(*) FILTER (auto_reply) AS approved, count(*) FILTER (NOT coalesce(auto_reply, FALSE)) AS blocked FROM kdoc", "kdoc"))
def a24(spark, sf_dir):
    return views.kdoc(spark, sf_dir).agg(F.count_if("auto_reply").alias("approved"), F.count_if(~F.coalesce("auto_reply", F.lit(False))).alias("blocked"))


@query("x23_goal_evaluation", sql("""m AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY salience DESC, id) AS n FROM memory), t AS (SELECT label, 0.5e0 * (1 + least(1e0, salience) / 2) AS w, CASE WHEN reward = 0 THEN 2 * least(greatest(confidence, 0e0), 1e0) - 1 ELSE reward END AS s FROM m WHERE n <= 8)
  SELECT label, round(least(greatest(0.7e0 * sum(w * s) / sum(w) + 0.3e0 * (0.4e0 * 2 - 1), -1e0), 1e0), 9) AS evaluation FROM t GROUP BY label""", "memory"))
def x23(spark, sf_dir):
    top = Window.partitionBy("label").orderBy(F.desc("salience"), "id")
    m = views.memory(spark, sf_dir).withColumn("n", F.row_number().over(top)).where("n <= 8")
    w = 0.5 * (1 + F.least(F.lit(1.0), F.col("salience")) / 2)
    s = F.when(F.col("reward") == 0, 2 * X.clamp(F.col("confidence"), 0.0, 1.0) - 1).otherwise(F.col("reward"))
    return m.groupBy("label").agg(F.round(X.clamp(0.7 * F.sum(w * s) / F.sum(w) + 0.3 * (0.4 * 2 - 1), -1.0, 1.0), 9).alias("evaluation"))
