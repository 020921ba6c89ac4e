"""Sources and sinks: what is written in a form of the library is read back from it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recallbase.operators.shared import new_folder
from recallbase.plans import views
from recallbase.plans.registry import query
from recallbase.plans.views import sql
from recallbase.session import table
from recallbase.sources import articles, documents, logs, monitoring, sinks

#: Category JSON in each of the forms that it comes in, by doc_id modulo 6, and what it means under _MAP: ids, labels, labels without ids.
_FORMS = (
    ('[3, "7", "Netzwerk"]', "3,7,4,9", "Netzwerk", ""), ('"Drucker"', "12", "Drucker", ""), ('[{"id": 5}, {"name": "Netzwerk  >  WLAN"}]', "5", "Netzwerk  >  WLAN", ""),
    ('[{"title": "Unbekannt"}, "Drucker"]', "12", "Unbekannt,Drucker", "Unbekannt"), (None, "", "", ""), ("11", "11", "", ""),
)
_MAP = '{"mappings": {"Netzwerk": [4, 9], "drucker": "12", "Netzwerk > WLAN": [5]}}'


def _case(k: int) -> str:
    return "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{f[k]}'" for i, f in enumerate(_FORMS) if f[k] is not None) + " END"


def _articles(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    raw = F.lit(None).cast("string")
    for i, form in enumerate(_FORMS):
        raw = F.when(F.col("doc_id") % 6 == i, F.lit(form[0])).otherwise(raw)
    return d.select(F.concat(F.lit("doc-"), "doc_id").alias("id"), F.substring("text", 1, 60).alias("title"), "text", F.col("source").alias("source"), F.col("lang").alias("language"), (F.col("n_chars") % 2 == 0).alias("auto_reply"), raw.alias("categories"))


def _mapping():
    return articles.category_map(F.lit(_MAP))


@query("s02_article_scan", f"""SELECT 'doc-' || doc_id AS id, substring(text, 1, 60) AS title, source, n_chars % 2 = 0 AND doc_id % 6 <> 3 AS auto_reply, {_case(1)} AS categories, {_case(2)} AS labels, {_case(3)} AS unmapped
  FROM documents WHERE source IN ('src0', 'src2', 'src5') AND trim(substring(text, 1, 60)) <> ''""")
def s02(spark, sf_dir):
    folder = new_folder(spark, "articles")
    sinks.write_articles(_articles(spark, sf_dir), folder)
    rows = articles.decode(articles.scan(spark, folder), ["src0", "src2", "SRC5 "], _mapping(), ignore=["*.tmp.json"])
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return rows.select("id", "title", "source", "auto_reply", joined("categories").alias("categories"), joined("labels").alias("labels"), joined("unmapped_labels").alias("unmapped"))


@query("s03_category_forms", f"SELECT doc_id, coalesce({_case(1)}, '') AS ids, coalesce({_case(2)}, '') AS labels, coalesce({_case(3)}, '') AS unmapped FROM documents")
def s03(spark, sf_dir):
    rows = _articles(spark, sf_dir).select(F.regexp_extract("id", r"\d+$", 0).cast("bigint").alias("doc_id"), articles.parse_categories(F.col("categories"), _mapping()).alias("c"))
    return rows.select("doc_id", F.array_join(F.transform("c.ids", lambda x: x.cast("string")), ",").alias("ids"), F.array_join("c.labels", ",").alias("labels"), F.array_join("c.unmapped", ",").alias("unmapped"))


@query("s04_category_map", """SELECT DISTINCT p_partkey, lower(p_name) AS label, unnest(CASE p_partkey % 3 WHEN 0 THEN [p_partkey] ELSE [p_partkey, p_size] END) AS id FROM part WHERE p_partkey > 0""")
def s04(spark, sf_dir):
    """A map for each part, flat or below `mappings`, ids as number, text or array."""
    k = F.col("p_partkey")
    both = F.concat_ws(",", k.cast("string"), F.col("p_size").cast("string"))
    ids = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.concat(F.lit("["), both, F.lit(", -1, 0]"))).otherwise(F.concat(F.lit('"'), both, F.lit('"')))
    flat = F.concat(F.lit('{"  '), F.upper("p_name"), F.lit('": '), ids, F.lit("}"))
    raw = F.when(k % 2 == 0, F.concat(F.lit('{"mappings": '), flat, F.lit("}"))).otherwise(flat)
    m = table(spark, sf_dir, "part").where("p_partkey > 0").select("p_partkey", F.explode(articles.category_map(raw)).alias("label", "ids"))
    return m.select("p_partkey", "label", F.explode("ids").alias("id"))


@query("s05_article_records", "SELECT 'doc-' || doc_id AS id, md5(lower(concat_ws(' ', 'doc-' || doc_id, substring(text, 1, 60), text, source))) AS blob FROM documents")
def s05(spark, sf_dir):
    return articles.record(_articles(spark, sf_dir).select("id", "title", "text", "source")).select("id", F.md5("blob").alias("blob"))


_RUN = "event_id long, event_type string, value double"


def _damaged_log(spark, sf_dir) -> str:
    """Events as JSON lines, every 97th cut short."""
    folder = new_folder(spark, "runlog")
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 97 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(folder)
    return folder


@query("s06_run_log", "SELECT event_id, event_type, value FROM events WHERE event_id % 97 <> 0")
def s06(spark, sf_dir):
    return logs.sound(logs.read_jsonl(spark, _damaged_log(spark, sf_dir), _RUN))


@query("s06_corrupt_lines", "SELECT count(*) AS lines, count(*) FILTER (event_id % 97 = 0) AS corrupt FROM events")
def s06_corrupt(spark, sf_dir):
    rows = logs.read_jsonl(spark, _damaged_log(spark, sf_dir), _RUN)
    return rows.agg(F.count("*").alias("lines"), F.count("_corrupt").alias("corrupt"))


_LOG = """e AS (SELECT user_id AS key, event_id AS seq, CASE event_type WHEN 'signup' THEN 'upsert' WHEN 'purchase' THEN 'replace' WHEN 'error' THEN 'delete' ELSE 'add' END AS op, event_id % 100 AS delta, props AS payload FROM events)"""
_FOLD = """s AS (SELECT key, max(seq) AS revision, arg_max(op, seq) AS op, arg_max(payload, seq) AS payload, arg_max(delta, seq) AS base FROM e WHERE op <> 'add' {0} GROUP BY key),
  a AS (SELECT e.key, sum(e.delta) AS added FROM e LEFT JOIN s USING (key) WHERE e.op = 'add' {0} AND (s.revision IS NULL OR e.seq > s.revision) GROUP BY e.key)
  SELECT key, payload, CAST(base + coalesce(added, 0) AS BIGINT) AS amount, revision FROM s LEFT JOIN a USING (key) WHERE op <> 'delete'"""


def _log(spark, sf_dir):
    t = F.col("event_type")
    op = F.when(t == "signup", "upsert").when(t == "purchase", "replace").when(t == "error", "delete").otherwise("add")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), op.alias("op"), (F.col("event_id") % 100).alias("delta"), F.col("props").alias("payload"))


@query("s08_event_fold", f"WITH {_LOG}, {_FOLD.format('')}")
def s08(spark, sf_dir):
    return logs.apply_events(_log(spark, sf_dir), "key", "seq")


_SEGMENTS = "SELECT user_id AS id, CAST(floor(event_id / 3) AS BIGINT) AS revision, event_id AS place, event_type = 'error' AS deleted, value FROM events"


def _segments(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.floor(F.col("event_id") / 3).alias("revision"), F.col("event_id").alias("place"), (F.col("event_type") == "error").alias("deleted"), "value")


@query("s10_live_records", f"WITH s AS ({_SEGMENTS}), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY revision DESC, place DESC) AS n FROM s) SELECT id, revision, place, value FROM r WHERE n = 1 AND NOT deleted")
def s10(spark, sf_dir):
    return logs.latest_records(_segments(spark, sf_dir)).select("id", "revision", "place", "value")


@query("a23_segment_counters", f"WITH s AS ({_SEGMENTS}), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY revision DESC, place DESC) AS n FROM s) SELECT count(*) AS records, count(*) FILTER (n = 1 AND NOT deleted) AS live, count(*) FILTER (n = 1 AND deleted) AS tombstones, count(*) FILTER (n > 1) AS superseded FROM r")
def a23(spark, sf_dir):
    return logs.segment_statistics(_segments(spark, sf_dir))


@query("s11_vector_scan", "SELECT vec_id AS id, embedding[1] AS first, CAST(len(embedding) AS INTEGER) AS size FROM embeddings WHERE len(embedding) = 64")
def s11(spark, sf_dir):
    """Also s12: the table holds other dimensions beside, whose files aren't opened."""
    folder = new_folder(spark, "vectors")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    sinks.partition_vectors(e.unionByName(e.withColumn("vector", F.slice("vector", 1, 16))), folder)
    return logs.vectors_of(spark, folder, 64).select("id", F.element_at("vector", 1).alias("first"), F.size("vector").alias("size"))


@query("s15_document_texts")
def s15(spark, sf_dir):
    """Files of three kinds, written and read as bytes. A test compares the texts with a parser."""
    p = table(spark, sf_dir, "pages")
    kinds = F.element_at(F.array(F.lit("html"), F.lit("txt"), F.lit("pdf")), (F.col("page_id") % 3 + 1).cast("int"))
    return documents.texts(p.select(F.concat(F.lit("p"), "page_id", F.lit("."), kinds).alias("name"), F.encode("html", "UTF-8").alias("content")))


@query("c07_char_chunks")
def c07(spark, sf_dir):
    return documents.chunked(table(spark, sf_dir, "documents"), "doc_id", 600, 70)


@query("s17_status_pages", """WITH b AS (SELECT user_id, event_id, ts, event_id % 5 AS st, row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%dT%H:%M:%S') DESC, event_id) AS n FROM events),
  m AS (SELECT 'page ' || user_id // 8 AS page, 'monitor' AS kind, user_id AS monitor_id, 'group / m' || user_id AS name, CASE st WHEN 0 THEN 'down' WHEN 1 THEN 'up' WHEN 2 THEN 'pending' WHEN 3 THEN 'maintenance' ELSE 'unknown' END AS status, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at FROM b WHERE n = 1)
  SELECT * FROM m WHERE status <> 'up' UNION ALL SELECT DISTINCT 'page 1', 'pinned_incident', CAST(NULL AS BIGINT), 'outage', 'incident', NULL FROM events WHERE user_id // 8 = 1 UNION ALL SELECT DISTINCT 'page ' || user_id // 8, 'maintenance', user_id // 8, 'window', 'maintenance', NULL FROM events WHERE user_id // 8 <> 1""")
def s17(spark, sf_dir):
    """Pages as JSON, of eight monitors each with their last hundred beats, as such a service sends them: every monitor's latest beat counts, the earlier in the list among equals."""
    beat = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("time"), (F.col("event_id") % 5).alias("status"), F.lit("m").alias("msg"))
    latest = Window.partitionBy("user_id").orderBy(F.desc(F.date_trunc("second", "ts")), "event_id")
    kept = table(spark, sf_dir, "events").withColumn("_n", F.row_number().over(latest)).where("_n <= 100")
    own = kept.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", beat.alias("beat")))), lambda x: x["beat"]).alias("beats"))
    page = F.floor(F.col("user_id") / 8)
    monitor = F.struct(F.col("user_id").alias("id"), F.concat(F.lit(" m"), "user_id").alias("name"))
    made = own.groupBy(page.alias("slug")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("user_id").cast("string"), "beats"))).alias("beats"), F.collect_list(monitor).alias("monitors"))
    incident = F.struct((F.col("slug") == 1).alias("pin"), F.lit("outage").alias("title"), F.lit("text").alias("content"))
    under = F.array(F.struct(F.col("slug").alias("id"), F.lit("window").alias("title"), F.when(F.col("slug") == 1, "over").otherwise("under-maintenance").alias("status")))
    raw = F.to_json(F.struct(F.concat(F.lit("page "), "slug").alias("title"), incident.alias("incident"), F.array(F.struct(F.lit("group").alias("name"), "monitors")).alias("groups"), under.alias("maintenance"), "beats"))
    return monitoring.page_issues(made.select(F.col("slug").cast("string").alias("slug"), raw.alias("raw"))).select("page", "kind", "monitor_id", "name", "status", "at")


@query("s18_metrics_text", """SELECT s_suppkey AS monitor_id, 'Supplier "' || s_suppkey || '", {a}' AS monitor_name, CASE s_suppkey % 5 WHEN 0 THEN 'down' WHEN 2 THEN 'pending' WHEN 3 THEN 'maintenance' ELSE 'unknown' END AS status, 'http' AS message,
  CASE s_suppkey % 5 WHEN 0 THEN 80 WHEN 2 THEN 60 WHEN 3 THEN 40 ELSE 10 END AS urgency FROM supplier WHERE s_suppkey % 5 <> 1""")
def s18(spark, sf_dir):
    """Also x24 and c43, c44: samples written as exposition text, whose label values hold quotes, commas and braces."""
    folder = new_folder(spark, "metrics")
    s = table(spark, sf_dir, "supplier")
    labels = F.create_map(F.lit("monitor_id"), F.col("s_suppkey").cast("string"), F.lit("monitor_name"), F.concat(F.lit('Supplier "'), "s_suppkey", F.lit('", {a}')), F.lit("monitor_type"), F.lit("http"))
    sinks.write_exposition(s.select(F.lit("monitor_status").alias("metric"), labels.alias("labels"), (F.col("s_suppkey") % 5).alias("value")), folder)
    found = monitoring.metric_issues(sinks.read_text(spark, folder))
    return found.withColumn("urgency", monitoring.issue_rank(F.lit("monitor"), F.col("status")))


@query("a26_latest_heartbeat", "SELECT user_id AS monitor_id, arg_max(event_id % 4, (ts, event_id)) AS beat, max(ts) AS at FROM events GROUP BY user_id")
def a26(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("monitor_id")).agg(F.max_by(F.col("event_id") % 4, F.struct("ts", "event_id")).alias("beat"), F.max("ts").alias("at"))


@query("k01_state_snapshot", sql("SELECT id, status, memory_type, version, salience FROM memory", "memory"))
def k01(spark, sf_dir):
    """Also k12: the text counts as secret and isn't written."""
    folder = new_folder(spark, "snapshot")
    sinks.snapshot(views.memory(spark, sf_dir).drop("vector"), folder, secrets=["text"])
    return spark.read.parquet(folder).select("id", "status", "memory_type", "version", "salience")


@query("k02_log_append", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def k02(spark, sf_dir):
    """Also k06: two appends to a log by day, read back."""
    folder = new_folder(spark, "log")
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    for part in (F.col("event_id") % 2 == 0, F.col("event_id") % 2 == 1):
        sinks.append_log(e.where(part), folder, F.col("ts"))
    return spark.read.schema("event_id long, day date").json(folder).groupBy("day").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("k03_checkpoint", f"WITH {_LOG}, " + _FOLD.format("AND seq <= 500"))
def k03(spark, sf_dir):
    folder = new_folder(spark, "checkpoint")
    sinks.checkpoint(_log(spark, sf_dir), "key", "seq", 500, folder)
    return spark.read.parquet(folder)


@query("k04_compacted_segments", f"WITH s AS ({_SEGMENTS}), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY revision DESC, place DESC) AS n FROM s) SELECT id, revision, value FROM r WHERE n = 1 AND NOT deleted")
def k04(spark, sf_dir):
    folder = new_folder(spark, "segments")
    sinks.compact(_segments(spark, sf_dir), folder)
    return spark.read.parquet(folder).select("id", "revision", "value")


@query("k07_vault", r"""WITH e AS (SELECT doc_id, 'lang-' || lang AS "to", upper(lang) AS title FROM documents WHERE lang IS NOT NULL UNION ALL SELECT doc_id, 'source-' || source, source FROM documents),
  l AS (SELECT doc_id, string_agg('- [[' || "to" || '|' || title || ']]', chr(10) ORDER BY "to", title) AS listed FROM e GROUP BY doc_id),
  p AS (SELECT 'articles/doc-' || doc_id || '.md' AS path, concat('---', chr(10), 'id: doc-', doc_id, chr(10), 'source: ', source, chr(10), '---', chr(10), chr(10), '# ', substring(text, 1, 60), chr(10), chr(10), text, chr(10), chr(10), listed, chr(10)) AS content FROM documents JOIN l USING (doc_id)
    UNION ALL SELECT DISTINCT 'linked/' || "to" || '.md', concat('# ', title, chr(10)) FROM e)
  SELECT path, CAST(strlen(content) AS BIGINT) AS bytes, sha256(content) AS sha256 FROM p""")
def k07(spark, sf_dir):
    """Also k08, g15: a page per article with its links, stubs for what it links to, a manifest."""
    d = table(spark, sf_dir, "documents")
    a = d.select(F.concat(F.lit("doc-"), "doc_id").alias("id"), F.substring("text", 1, 60).alias("title"), "text", "source")
    own = F.concat(F.lit("doc-"), "doc_id").alias("from")
    edges = d.where("lang is not null").select(own, F.concat(F.lit("lang-"), "lang").alias("to"), F.upper("lang").alias("title")).unionByName(d.select(own, F.concat(F.lit("source-"), "source").alias("to"), F.col("source").alias("title")))
    return sinks.write_vault(sinks.vault_pages(a, edges), new_folder(spark, "vault"))


@query("k09_metrics_exposition", sql("""SELECT 'http_requests_total{code="' || code || '",method="' || method || '",route="' || route || '"} ' || count(*) AS line FROM http_request GROUP BY method, route, code""", "http_request"))
def k09(spark, sf_dir):
    """Also k10."""
    folder = new_folder(spark, "exposition")
    g = views.http_request(spark, sf_dir).groupBy("method", "route", "code").agg(F.count("*").alias("value"))
    labels = F.create_map(F.lit("method"), F.col("method"), F.lit("route"), F.col("route"), F.lit("code"), F.col("code").cast("string"))
    sinks.write_exposition(g.select(F.lit("http_requests_total").alias("metric"), labels.alias("labels"), "value"), folder)
    return sinks.read_text(spark, folder).select(F.col("value").alias("line"))


@query("k11_article_json", "SELECT doc_id AS key, sha256('{\"id\":' || to_json('doc-' || doc_id) || ',\"title\":' || to_json(upper(lang)) || ',\"text\":' || to_json(text) || ',\"auto_reply\":' || to_json(n_chars % 2 = 0) || ',\"source\":' || to_json(source) || '}') AS json_sha FROM documents")
def k11(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source"), (F.col("n_chars") % 2 == 0).alias("auto_reply"), F.upper("lang").alias("title"), F.concat(F.lit("doc-"), "doc_id").alias("id"))
    return a.select(F.col("doc_id").alias("key"), F.sha2(sinks.article_json(a.drop("doc_id")), 256).alias("json_sha"))
