"""The driver's tables in the shapes that the operators work on. Each view exists twice: as a DataFrame, and as SQL for the oracle.

Every view is deterministic and keeps all rows of its tables; joins are on ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallbase.session import table


def _pick(number, *names: str):
    out = F.lit(names[-1])
    for i, name in reversed(list(enumerate(names[:-1]))):
        out = F.when(number == i, name).otherwise(out)
    return out


def memory(spark: SparkSession, sf_dir: str, body: str = "text") -> DataFrame:
    """A memory per embedding, with its document's text, or what `body` makes of it before the joins, and its event's time."""
    e, d, v = (table(spark, sf_dir, n) for n in ("embeddings", "documents", "events"))
    d = d.select("doc_id", "n_chars", "source", "lang", F.expr(body).alias("text"))
    rows = e.join(d, e.vec_id == d.doc_id).join(v.select("event_id", "ts"), e.vec_id == F.col("event_id"))
    n, i = F.col("n_chars"), F.col("vec_id")
    return rows.select(
        i.alias("id"), _pick(F.col("label") % 4, "episodic", "semantic", "procedural", "working").alias("memory_type"),
        F.when(i % 20 == 19, "archived").when(i % 20 == 18, "superseded").when(i % 20 == 17, "conflicted").otherwise("active").alias("status"),
        (F.lit(0.5) + (n % 200).cast("double") / 100).alias("salience"), (F.lit(0.2) + (n % 80).cast("double") / 100).alias("confidence"), ((i % 21 - 10).cast("double") / 10).alias("reward"),
        (n % 17).alias("access_count"), F.col("ts").alias("created_at"), F.concat(F.lit("kind-"), (F.col("label") % 3).cast("string")).alias("kind"),
        F.concat(F.lit("truth-"), (i % 60).cast("string")).alias("truth_key"), (1 + n % 3).alias("version"), F.col("label").cast("int").alias("label"), F.col("embedding").alias("vector"), "source", "lang", "text",
    )


def synapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges a < b between memories whose ids share a remainder, each id with the next two of its class; weights by id."""
    m = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("a"), F.col("label").alias("la"))
    steps = m.select("a", "la", F.explode(F.array(F.lit(7), F.lit(30))).alias("step")).withColumn("b", F.col("a") + F.col("step"))
    ends = m.select(F.col("a").alias("b"), F.col("la").alias("lb"))
    kept = steps.join(ends, "b").where("(a * 31 + step) % 4 <> 0")
    return kept.select("a", "b", ((F.col("a") * 7 + F.col("b")) % 90 + 10).cast("double").alias("w")).select("a", "b", (F.col("w") / 100).alias("weight"))


def kdoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A knowledge article per document; those without labels need approval."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_id"), "quality")
    return d.join(lab, F.col("doc_id") == F.col("l_id"), "left").select(F.col("doc_id").alias("id"), F.substring("text", 1, 60).alias("title"), "text", F.col("lang").alias("language"), (F.col("quality") == 1).alias("auto_reply"), "source", "n_chars")


def research_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace of research runs, from the event stream."""
    v, i = table(spark, sf_dir, "events"), F.col("event_id")
    learned = _pick(i % 3, "evidence.corroborated", "evidence.learned", "evidence.duplicate")
    kind = F.col("event_type")
    what = F.when(kind == "view", "search.result").when(kind == "click", "download.completed").when(kind == "signup", "claim.extracted").when(kind == "purchase", learned).otherwise("source.rejected")
    return v.select(i.alias("seq"), F.col("user_id").alias("run_id"), (F.col("user_id") % 7).alias("goal_id"), what.alias("type"), F.when(kind == "error", "error").otherwise("ok").alias("status"), (i % 500).alias("memory_id"), (i % 250).alias("source_id"), F.col("ts").alias("created_at"), "value")


def http_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "events")
    return v.select(
        F.when(F.col("user_id") % 4 == 0, "POST").otherwise("GET").alias("method"), F.concat(F.lit("/"), "event_type").alias("route"),
        F.when(F.col("event_type") == "error", 500).when(F.col("event_id") % 25 == 0, 404).otherwise(200).alias("code"), (F.col("event_id") % 1000 * 10).alias("bytes"), (F.col("value") / 100).alias("seconds"),
    )


def job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue of jobs, from orders."""
    o, c, k = table(spark, sf_dir, "orders"), F.col("o_custkey"), F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", F.when(c % 10 == 0, "failed").otherwise("done")).when(F.col("o_orderstatus") == "O", "queued").otherwise(_pick(k % 4, "claimed", "retry_wait", "apply_wait", "blocked"))
    return o.select(
        k.alias("id"), _pick(c % 3, "vector.relink", "model.embed", "model.chat").alias("type"), status.alias("status"), (10 * (6 - F.substring("o_orderpriority", 1, 1).cast("int"))).alias("priority"),
        F.when(c % 2 == 0, "cpu").otherwise("gpu").alias("resource"), F.floor("o_totalprice").cast("long").alias("payload_bytes"), F.col("o_orderdate").alias("created_at"), (k % 4).alias("attempts"),
        F.concat(F.lit("w"), (c % 9).cast("string")).alias("worker"), (k % 12).alias("lease_hours"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model calls with token counts, from order lines."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.lit("model-"), "l_returnflag", "l_linestatus").alias("model"), F.when(F.col("l_linenumber") % 3 == 0, "embedding").otherwise("chat").alias("category"),
        F.floor(F.col("l_quantity") * 1000).cast("long").alias("input_tokens"), (F.floor(F.col("l_quantity") * 10) * F.col("l_linenumber")).cast("long").alias("cached_tokens"), F.floor("l_extendedprice").cast("long").alias("output_tokens"), F.col("l_shipdate").alias("created_at"),
    )


def ticket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ticket per conversation: its first turn and how many turns follow."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy(F.col("conv_id").alias("ticket_id")).agg(F.min(F.when(F.col("turn") == 0, F.col("text"))).alias("content"), F.count("*").alias("turns"))


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("uri"), "html", ((F.col("page_id") % 100).cast("double") / 100).alias("trust"))


#: The same views for the oracle.
SQL = {
    "memory": """memory AS (SELECT e.vec_id AS id, CASE e.label % 4 WHEN 0 THEN 'episodic' WHEN 1 THEN 'semantic' WHEN 2 THEN 'procedural' ELSE 'working' END AS memory_type,
        CASE e.vec_id % 20 WHEN 19 THEN 'archived' WHEN 18 THEN 'superseded' WHEN 17 THEN 'conflicted' ELSE 'active' END AS status,
        0.5e0 + CAST(d.n_chars % 200 AS DOUBLE) / 100e0 AS salience, 0.2e0 + CAST(d.n_chars % 80 AS DOUBLE) / 100e0 AS confidence, CAST(e.vec_id % 21 - 10 AS DOUBLE) / 10e0 AS reward,
        d.n_chars % 17 AS access_count, v.ts AS created_at, 'kind-' || CAST(e.label % 3 AS VARCHAR) AS kind, 'truth-' || CAST(e.vec_id % 60 AS VARCHAR) AS truth_key, 1 + d.n_chars % 3 AS version,
        CAST(e.label AS INTEGER) AS label, CAST(e.embedding AS DOUBLE[]) AS vector, d.source, d.lang, d.text
        FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id JOIN events v ON v.event_id = e.vec_id)""",
    "synapse": """synapse AS (SELECT a.vec_id AS a, b.vec_id AS b, CAST((a.vec_id * 7 + b.vec_id) % 90 + 10 AS DOUBLE) / 100e0 AS weight
        FROM embeddings a JOIN (SELECT unnest([7, 30]) AS step) s ON TRUE JOIN embeddings b ON b.vec_id = a.vec_id + s.step WHERE (a.vec_id * 31 + s.step) % 4 <> 0)""",
    "kdoc": """kdoc AS (SELECT d.doc_id AS id, substring(text, 1, 60) AS title, text, lang AS language, l.quality = 1 AS auto_reply, source, n_chars FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)""",
    "research_event": """research_event AS (SELECT event_id AS seq, user_id AS run_id, user_id % 7 AS goal_id,
        CASE event_type WHEN 'view' THEN 'search.result' WHEN 'click' THEN 'download.completed' WHEN 'signup' THEN 'claim.extracted' WHEN 'purchase' THEN
          CASE event_id % 3 WHEN 0 THEN 'evidence.corroborated' WHEN 1 THEN 'evidence.learned' ELSE 'evidence.duplicate' END ELSE 'source.rejected' END AS type,
        CASE event_type WHEN 'error' THEN 'error' ELSE 'ok' END AS status, event_id % 500 AS memory_id, event_id % 250 AS source_id, ts AS created_at, value FROM events)""",
    "http_request": """http_request AS (SELECT CASE WHEN user_id % 4 = 0 THEN 'POST' ELSE 'GET' END AS method, '/' || event_type AS route,
        CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 25 = 0 THEN 404 ELSE 200 END AS code, event_id % 1000 * 10 AS bytes, value / 100e0 AS seconds FROM events)""",
    "job": """job AS (SELECT o_orderkey AS id, CASE o_custkey % 3 WHEN 0 THEN 'vector.relink' WHEN 1 THEN 'model.embed' ELSE 'model.chat' END AS type,
        CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_custkey % 10 = 0 THEN 'failed' ELSE 'done' END WHEN 'O' THEN 'queued' ELSE
          CASE o_orderkey % 4 WHEN 0 THEN 'claimed' WHEN 1 THEN 'retry_wait' WHEN 2 THEN 'apply_wait' ELSE 'blocked' END END AS status,
        10 * (6 - CAST(substring(o_orderpriority, 1, 1) AS INTEGER)) AS priority, CASE WHEN o_custkey % 2 = 0 THEN 'cpu' ELSE 'gpu' END AS resource, CAST(floor(o_totalprice) AS BIGINT) AS payload_bytes,
        o_orderdate AS created_at, o_orderkey % 4 AS attempts, 'w' || CAST(o_custkey % 9 AS VARCHAR) AS worker, o_orderkey % 12 AS lease_hours FROM orders)""",
    "usage": """usage AS (SELECT l_orderkey * 10 + l_linenumber AS id, 'model-' || l_returnflag || l_linestatus AS model, CASE WHEN l_linenumber % 3 = 0 THEN 'embedding' ELSE 'chat' END AS category,
        CAST(floor(l_quantity * 1000) AS BIGINT) AS input_tokens, CAST(floor(l_quantity * 10) * l_linenumber AS BIGINT) AS cached_tokens, CAST(floor(l_extendedprice) AS BIGINT) AS output_tokens, l_shipdate AS created_at FROM lineitem)""",
    "ticket": """ticket AS (SELECT conv_id AS ticket_id, min(CASE WHEN turn = 0 THEN text END) AS content, count(*) AS turns FROM conversations GROUP BY conv_id)""",
    "source": """source AS (SELECT page_id AS id, url AS uri, html, CAST(page_id % 100 AS DOUBLE) / 100e0 AS trust FROM pages)""",
}


def sql(body: str, *views: str) -> str:
    """body after the named views."""
    return "WITH " + ",\n".join(SQL[v] for v in views) + ("\n" if body.lstrip().upper().startswith("SELECT") else ",\n") + body
