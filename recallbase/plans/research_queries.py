"""Goal research, tickets' context, workers: the smaller entries of the inventory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recallbase.functions import exprs as X
from recallbase.functions import hashes as H
from recallbase.functions import text as T
from recallbase.operators import jobs as J
from recallbase.operators import lifecycle as L
from recallbase.operators import research as R
from recallbase.plans import views
from recallbase.plans.registry import query
from recallbase.plans.rule_queries import _rendezvous_sql
from recallbase.plans.views import sql
from recallbase.session import table

c = F.col


_KIND = """CASE WHEN regexp_matches(lower(regexp_extract(uri, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '\\.({})$') OR kind IN ({}) THEN 'document' ELSE 'page' END""".format("|".join(x[1:] for x in R.DOCUMENT_SUFFIXES), ", ".join(f"'{x}'" for x in R.DOCUMENT_TYPES))


@query("s14_resource_kinds", f"""WITH u AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_replace(url, '/([0-9]+)', '/\\1.PDF') WHEN page_id % 3 = 1 THEN regexp_replace(url, '\\?', '.csv?') ELSE url END AS uri, CASE WHEN page_id % 7 = 0 THEN 'text/markdown' ELSE 'text/html' END AS kind FROM pages)
  SELECT page_id, {_KIND} AS kind FROM u""")
def s14(spark, sf_dir):
    """Addresses of pages, a third with an ending behind their number, a third with one before the query they may have; every seventh is said to be Markdown."""
    k = c("page_id") % 3
    uri = F.when(k == 0, F.regexp_replace("url", "^(.*?)/([0-9]+)", "$1/$2.PDF")).when(k == 1, F.regexp_replace("url", r"^([^?]*)\?", "$1.csv?")).otherwise(c("url"))
    kind = F.when(c("page_id") % 7 == 0, "text/Markdown; charset=utf-8").otherwise("text/html")
    return table(spark, sf_dir, "pages").select("page_id", R.resource_kind(uri, kind).alias("kind"))


@query("s13_meta_search", """WITH h AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages), q AS (SELECT DISTINCT host FROM h WHERE page_id % 50 = 0),
  r AS (SELECT host, url, page_id, row_number() OVER (PARTITION BY host ORDER BY page_id) AS place FROM h WHERE host IN (SELECT host FROM q))
  SELECT host AS query, CAST(place AS INTEGER) AS place, url, 'page ' || CAST(page_id AS VARCHAR) AS title, round(1e0 / CAST(place AS DOUBLE), 9) AS score FROM r WHERE place <= 10""")
def s13(spark, sf_dir):
    """Recorded answers of a meta-search for stated queries, the hosts of every fiftieth page: ten results each."""
    from recallbase.operators.shared import new_folder
    from recallbase.sources import websearch

    h = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1).alias("host"))
    asked = [r.host for r in h.where("page_id % 50 = 0").select("host").distinct().orderBy("host").collect()]  # the stated queries
    w = Window.partitionBy("host").orderBy("page_id")
    found = h.withColumn("place", F.row_number().over(w)).where("place <= 12").select(c("host").alias("query"), "place", F.concat(F.lit("page "), c("page_id").cast("string")).alias("title"), "url", (1 / c("place")).alias("score"))
    folder = new_folder(spark, "answers")
    websearch.record(found, folder)
    return websearch.search(spark, folder, asked, most=10).select("query", "place", "url", "title", F.round("score", 9).alias("score"))


@query("s19_context_assembly", """WITH t AS (SELECT user_id AS ticket_id, 'change' AS kind, event_id AS id, value AS relevance FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, 'incident', event_id, value FROM events WHERE event_type = 'error' UNION ALL SELECT user_id, 'issue', event_id, value FROM events WHERE event_type = 'click'),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY ticket_id, kind ORDER BY relevance DESC, id) AS INTEGER) AS rank FROM t) SELECT ticket_id, kind, id, rank FROM r WHERE rank <= 10""")
def s19(spark, sf_dir):
    """s19, l13, r28: the ten most relevant context records of each kind."""
    e = table(spark, sf_dir, "events")
    part = lambda t: e.where(c("event_type") == t).select(c("user_id").alias("ticket_id"), c("event_id").alias("id"), c("value").alias("relevance"))
    return R.context_rows([("change", part("view")), ("incident", part("error")), ("issue", part("click"))], 10).select("ticket_id", "kind", "id", "rank")


@query("r05_preferred_sites", """SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'learn.microsoft.com,support.microsoft.com,www.cisco.com,docs.cisco.com' WHEN 1 THEN 'ubuntu.com,documentation.ubuntu.com' ELSE '' END AS sites FROM conversations WHERE turn = 0""")
def r05(spark, sf_dir):
    k = c("conv_id") % 3
    goal = F.when(k == 0, "Cisco VPN unter Windows, Outlook").when(k == 1, "Ubuntu-Server").otherwise("ubuntuserver")
    return table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", F.array_join(R.preferred_sites(goal), ",").alias("sites"))


@query("x25_fetch_order", sql("""r AS (SELECT id % 30 AS query_id, id, trust AS score, contains(lower(html), 'the') AS relevant, CASE WHEN trust >= 0.9e0 THEN 0.65e0 ELSE 0.50e0 END AS authority FROM source),
  o AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY relevant DESC, authority DESC, score DESC, id) AS INTEGER) AS place FROM r) SELECT query_id, id, place FROM o WHERE place <= 5""", "source"))
def x25(spark, sf_dir):
    s = views.source(spark, sf_dir).select((c("id") % 30).alias("query_id"), "id", c("trust").alias("score"), "html")
    return R.fetch_order(s, F.lower("html").contains("the"), F.when(c("score") >= 0.9, 0.65).otherwise(0.50), 5).select("query_id", "id", "place")


@query("r14_goal_keywords", r"""WITH w AS (SELECT conv_id, regexp_replace(unnest(regexp_split_to_array(translate(lower(text), '/-_', '   '), '\s+')), '^[.,:;()\[\]{}]+|[.,:;()\[\]{}]+$', '', 'g') AS w FROM conversations WHERE turn = 0)
  SELECT conv_id, CAST(count(DISTINCT w) AS INTEGER) AS n, min(w) AS first FROM w WHERE strlen(w) >= 3 GROUP BY conv_id""")
def r14(spark, sf_dir):
    k = table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", R.goal_keywords(c("text")).alias("k")).where(F.size("k") > 0)
    return k.select("conv_id", F.size("k").alias("n"), F.element_at("k", 1).alias("first"))


@query("r07_predictions", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'rises' WHEN 1 THEN 'last' ELSE 'none' END AS prediction, CASE event_id % 3 WHEN 0 THEN 'wait' ELSE 'again' END AS next FROM events""")
def r07(spark, sf_dir):
    k = c("event_id") % 3
    raw = F.when(k == 0, " Prediction:  rises \nNEXT: wait").when(k == 1, "PREDICTION: first\nprediction:last").otherwise("The PREDICTION: no")
    return table(spark, sf_dir, "events").select("event_id", R.labelled_line(raw, "PREDICTION", F.lit("none")).alias("prediction"), R.labelled_line(raw, "NEXT", F.lit("again")).alias("next"))


@query("r06_observations", sql(r"""h AS (SELECT id % 40 AS query_id, reward, text, row_number() OVER (PARTITION BY id % 40 ORDER BY salience DESC, id) AS rank FROM memory),
  f AS (SELECT query_id, rank, reward, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM h WHERE rank <= 5) SELECT query_id, md5(string_agg(printf('sim=%.2f reward=%.2f: ', 0.5e0, reward) || CASE WHEN length(t) > 220 THEN substring(t, 1, 220) || '…' ELSE t END, ' | ' ORDER BY rank)) AS observation FROM f GROUP BY query_id""", "memory"))
def r06(spark, sf_dir):
    m = views.memory(spark, sf_dir).select((c("id") % 40).alias("query_id"), "id", "reward", "text", "salience")
    hits = m.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("salience"), "id"))).withColumn("similarity", F.lit(0.5))
    return R.observation(hits).select("query_id", F.md5("observation").alias("observation"))


@query("r21_live_workers", sql("""w AS (SELECT worker, count(*) FILTER (status = 'claimed' AND lease_hours > 6) AS inflight FROM job GROUP BY worker) SELECT count(*) FILTER (inflight < 3) AS free, count(*) FILTER (inflight < 3) > 0 AS any_live FROM w""", "job"))
def r21(spark, sf_dir):
    """r21, t15: workers that have room left; a planner needs one of them."""
    w = views.job(spark, sf_dir).groupBy("worker").agg(F.count_if((c("status") == "claimed") & (c("lease_hours") > 6)).alias("inflight"))
    return w.agg(F.count_if(c("inflight") < 3).alias("free"), (F.count_if(c("inflight") < 3) > 0).alias("any_live"))


@query("r22_retry_and_compact", sql("""SELECT id, CASE WHEN status IN ('failed', 'canceled') THEN 'queued' ELSE status END AS status, CASE WHEN status IN ('failed', 'canceled') THEN 0 ELSE attempts END AS attempts, CASE WHEN status = 'done' AND type = 'vector.relink' THEN NULL ELSE payload_bytes END AS payload_bytes FROM job""", "job"))
def r22(spark, sf_dir):
    """r22, r23, r27: failed jobs back in the queue, payloads of settled relink jobs dropped."""
    return J.compacted(J.retried(views.job(spark, sf_dir))).select("id", "status", "attempts", "payload_bytes")


@query("t04_completion", sql("""SELECT id, CASE WHEN attempts >= 3 THEN 'failed' WHEN id % 2 = 0 THEN 'retry_wait' WHEN priority > 30 THEN 'apply_wait' ELSE 'done' END AS outcome, CASE WHEN id % 2 = 0 AND attempts < 3 THEN CAST(least(3600, 15 * pow(2, least(greatest(attempts - 1, 0), 6))) AS BIGINT) END AS wait_s
  FROM job WHERE status = 'claimed'""", "job").replace("CASE WHEN attempts >= 3 THEN 'failed' WHEN id % 2 = 0 THEN 'retry_wait'", "CASE WHEN id % 2 = 0 THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'retry_wait' END"))
def t04(spark, sf_dir):
    """t04, t05: what becomes of a claimed job by its result, and how long a retry waits."""
    failed = c("id") % 2 == 0
    retry = failed & (c("attempts") < 3)
    outcome = F.when(retry, "retry_wait").when(failed, "failed").when(c("priority") > 30, "apply_wait").otherwise("done")
    return views.job(spark, sf_dir).where("status = 'claimed'").select("id", outcome.alias("outcome"), F.when(retry, J.backoff_seconds(F.lit(15.0), c("attempts"))).alias("wait_s"))


@query("t13_escalation_scan", "SELECT conv_id AS ticket_id, count(*) AS turns FROM conversations GROUP BY conv_id HAVING conv_id % 48 >= 24")
def t13(spark, sf_dir):
    """t13: tickets of an age, here a day or more by hours from their id."""
    t = views.ticket(spark, sf_dir).select("ticket_id", "turns", (c("ticket_id") % 48).alias("age_hours"))
    return t.where("age_hours >= 24").select("ticket_id", "turns")


@query("m24_feedback", """WITH e AS (SELECT user_id AS a, event_id % 30 AS b, CAST(floor(event_id / 500) AS BIGINT) AS d, least(greatest(value / 200e0 - 1, -1e0), 1e0) * 0.1e0 AS delta FROM events), s AS (SELECT a, b, d, sum(least(delta, 0e0)) AS l, sum(greatest(delta, 0e0)) AS w FROM e GROUP BY a, b, d),
  n AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY d) AS k FROM s) SELECT a, b, count(*) AS days, round(CAST(sum(l) + sum(w) AS DOUBLE), 6) AS total FROM n GROUP BY a, b""")
def m24(spark, sf_dir):
    """m24: ratings of answers reinforce the edges to what they were based on; a large limit leaves the plain sums."""
    e = table(spark, sf_dir, "events").select(c("user_id").alias("a"), (c("event_id") % 30).alias("b"), F.floor(c("event_id") / 500).alias("at_day"), (X.clamp(c("value") / 200 - 1, -1.0, 1.0) * 0.1).alias("delta"))
    days = e.groupBy("a", "b").agg(F.count_distinct("at_day").alias("days"))
    return L.reinforce(e, 0.0, 1e9).join(days, ["a", "b"]).select("a", "b", "days", F.round("weight", 6).alias("total"))


@query("m25_rebalance_plan", sql("t AS (" + _rendezvous_sql("SELECT id FROM memory WHERE status <> 'archived'", {"local": 1.0, "east": 2.0, "west": 1.0}) + """), h AS (SELECT CASE WHEN id % 3 = 0 THEN 'east' ELSE 'local' END AS home, target FROM t)
  SELECT home, target, count(*) AS memories, count(*) FILTER (home <> target) AS to_move FROM h GROUP BY home, target""", "memory"))
def m25(spark, sf_dir):
    """m25: memories per home and target shard, a dry run."""
    pick = H.rendezvous(["local", "east", "west"], [1.0, 2.0, 1.0])
    m = views.memory(spark, sf_dir).where("status <> 'archived'").select(F.when(c("id") % 3 == 0, "east").otherwise("local").alias("home"), pick(c("id").cast("string")).alias("target"))
    return m.groupBy("home", "target").agg(F.count("*").alias("memories"), F.count_if(c("home") != c("target")).alias("to_move"))


@query("v06_namespaced_search", sql("""s AS (SELECT q.id AS query_id, m.id, round(list_dot_product(q.vector, m.vector) / (sqrt(list_dot_product(q.vector, q.vector)) * sqrt(list_dot_product(m.vector, m.vector))), 9) AS s FROM memory q JOIN memory m ON m.id <> q.id WHERE q.id % 50 = 0 AND m.source = 'src3'),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS INTEGER) AS rank FROM s) SELECT query_id, id, round(s, 6) AS similarity, rank FROM r WHERE rank <= 128""", "memory"))
def v06(spark, sf_dir):
    """v06, v21, r36, r37, r46, r54: the nearest of one namespace, whatever their similarity."""
    from recallbase.operators import vectors as V

    m = views.memory(spark, sf_dir)
    q = m.where("id % 50 = 0").select(c("id").alias("query_id"), "vector")
    return V.neighbours(q, m.where("source = 'src3'"), 128, -1.0).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


def _plain(html: str) -> str:
    """SQL for the text of a page, as T.html_to_text has it."""
    out = html
    for pattern, by in ((r"(?is)<script\b[^>]*>.*?</script>", " "), (r"(?is)<style\b[^>]*>.*?</style>", " "), (r"(?s)<!--.*?-->", " "), (r"</p>|</h[1-3]>", "\n\n"), (r"</div>|</li>|<br ?/?>", "\n"), (r"<[^>]*>", " ")):
        made = " || ".join("chr(10)" if ch == "\n" else f"'{ch}'" for ch in by)
        out = f"regexp_replace({out}, '{pattern}', {made}, 'g')"
    for entity, plain in T.ENTITIES.items():
        made = plain.replace("'", "''")
        out = f"replace({out}, '{entity}', '{made}')"
    lines = f"array_to_string(list_transform(string_split(replace({out}, chr(13), ''), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), chr(10))"
    return f"regexp_replace(regexp_replace({lines}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query("c08_page_texts", f"SELECT page_id, length(t) AS length, md5(t) AS text FROM (SELECT page_id, {_plain('html')} AS t FROM pages)")
def c08(spark, sf_dir):
    """c08, c09, r50: the whole texts of pages, as checksums; a test compares the texts with a parser, too."""
    t = table(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("t"))
    return t.select("page_id", F.length("t").cast("long").alias("length"), F.md5(F.col("t").cast("binary")).alias("text"))


@query("a12_pending_by_kind", sql("SELECT type, count(*) FILTER (status NOT IN ('done', 'completed', 'failed', 'error', 'canceled')) AS pending, min(created_at) FILTER (status = 'queued') AS oldest FROM job GROUP BY type", "job"))
def a12(spark, sf_dir):
    return views.job(spark, sf_dir).groupBy("type").agg(F.count_if(~c("status").isin(*J.TERMINAL)).alias("pending"), F.min(F.when(c("status") == "queued", c("created_at"))).alias("oldest"))


@query("r51_devices", "SELECT DISTINCT o_custkey AS user_id, lower(o_orderpriority) || ':' || o_custkey % 3 AS device FROM orders UNION SELECT o_custkey, 'computer:' || o_orderkey % 2 FROM orders")
def r51(spark, sf_dir):
    """r51: linked items and a user's own devices, each once."""
    o = table(spark, sf_dir, "orders")
    linked = o.select(c("o_custkey").alias("user_id"), F.concat(F.lower("o_orderpriority"), F.lit(":"), (c("o_custkey") % 3).cast("string")).alias("device"))
    own = o.select(c("o_custkey").alias("user_id"), F.concat(F.lit("computer:"), (c("o_orderkey") % 2).cast("string")).alias("device"))
    return linked.unionByName(own).distinct()
