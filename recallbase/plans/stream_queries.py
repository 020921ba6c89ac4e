"""Streams over the fact tables, drained into a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallbase.operators.budget import reserve
from recallbase.operators.shared import new_folder
from recallbase.plans import views
from recallbase.plans.registry import query
from recallbase.plans.views import sql
from recallbase.session import table
from recallbase.streaming import heap, queue, streams, timers

_LATE = "2 days"
_EDGE = "(SELECT max(ts) - INTERVAL 2 DAY FROM events)"


def _events(spark, sf_dir):
    return streams.event_time(streams.table_stream(spark, f"{sf_dir}/events.parquet"), "ts", _LATE)


@query("t_daily_cost", f"""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2 HAVING CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 1 DAY <= {_EDGE}""")
def daily_cost(spark, sf_dir):
    """a10 as a stream: tumbling days that the watermark has closed."""
    w = streams.tumbling(_events(spark, sf_dir), "1 day", ["event_type"], F.count("*").alias("n"), F.sum("value").alias("total"))
    return streams.drain(w, "daily").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("t14_research_trace", sql(f"""SELECT CAST(date_trunc('day', created_at) AS TIMESTAMP) AS start, run_id, count(*) AS events, max(seq) AS last_seq, count(*) FILTER (status = 'error') AS errors
  FROM research_event GROUP BY 1, 2 HAVING CAST(date_trunc('day', created_at) AS TIMESTAMP) + INTERVAL 1 DAY <= {_EDGE}""", "research_event"))
def t14(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.col("user_id").alias("run_id"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), "at")
    w = streams.tumbling(rows, "1 day", ["run_id"], F.count("*").alias("events"), F.max("seq").alias("last_seq"), F.count_if(F.col("status") == "error").alias("errors"))
    return streams.drain(w, "trace").select(F.col("start").cast("timestamp_ntz").alias("start"), "run_id", "events", "last_seq", "errors")


@query("t_sessions", f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
  SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, s HAVING max(ts) + INTERVAL 6 HOUR <= {_EDGE}""")
def sessions(spark, sf_dir):
    s = streams.drain(streams.sessions(_events(spark, sf_dir), "6 hours", ["user_id"], F.count("*").alias("n")), "sessions")
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("t11_seen_versions", "SELECT DISTINCT user_id, event_type FROM events")
def t11(spark, sf_dir):
    """Also t09, t10, t12: a key within the watermark, here of all time, counts once."""
    rows = streams.event_time(streams.table_stream(spark, f"{sf_dir}/events.parquet"), "ts", "36500 days")
    return streams.drain(streams.first_of(rows, "user_id", "event_type").select("user_id", "event_type"), "seen")


@query("t18_incremental_sync", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def t18(spark, sf_dir):
    rows = streams.table_stream(spark, f"{sf_dir}/events.parquet", files_per_batch=1).select("user_id", "event_id", "event_type")
    return streams.merge_latest(rows, new_folder(spark, "sync"), "user_id", "event_id").select("user_id", "event_type", "event_id")


@query("t16_idempotent_batches", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def t16(spark, sf_dir):
    folder = new_folder(spark, "batches")
    streams.append_batches(streams.table_stream(spark, f"{sf_dir}/events.parquet").select("event_id", "event_type"), folder)
    return spark.read.parquet(f"{folder}/rows").groupBy("event_type").agg(F.count("*").alias("n"))


def commands(events):
    """Commands on a job per user: the events' kinds as operations, five workers, seconds of event time."""
    t = F.col("event_type")
    op = F.when(t == "signup", "enqueue").when(t == "view", "claim").when(t == "click", "heartbeat").when(t == "purchase", "done").otherwise("error")
    return events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("w"), (F.col("event_id") % 2).cast("string")).alias("worker"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))


@query("t01_queue_transitions")
def t01(spark, sf_dir):
    """Also t02 to t06, r20, r22: enqueue, claim, heartbeat, completion and refusal per job. A test compares them with a plain loop."""
    return streams.drain(queue.transitions(commands(streams.table_stream(spark, f"{sf_dir}/events.parquet")), lease=7200.0, base=600.0), "queue")


@query("t20_working_ttl", sql("SELECT id FROM memory WHERE memory_type = 'working' AND date_diff('microsecond', created_at, TIMESTAMP '2024-02-15 00:00:00') >= 600 * 3600000000", "memory"))
def t20(spark, sf_dir):
    m = views.memory(spark, sf_dir)
    age = F.unix_micros(F.lit("2024-02-15 00:00:00").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))
    return m.where((F.col("memory_type") == "working") & (age >= 600 * 3_600_000_000)).select("id")


@query("t19_reservations", """WITH RECURSIVE o AS (SELECT CAST(o_orderdate AS DATE) AS day, CAST(round(o_totalprice * 100) AS BIGINT) AS cost, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS k FROM orders),
  r AS (SELECT day, CAST(0 AS BIGINT) AS k, CAST(0 AS HUGEINT) AS spent, false AS granted FROM o GROUP BY day
    UNION ALL SELECT o.day, o.k, r.spent + CASE WHEN r.spent + o.cost <= 50000000 THEN o.cost ELSE 0 END, r.spent + o.cost <= 50000000 FROM r JOIN o ON o.day = r.day AND o.k = r.k + 1)
  SELECT day, count(*) FILTER (granted) AS granted, count(*) FILTER (NOT granted) AS refused FROM r WHERE k > 0 GROUP BY day""")
def t19(spark, sf_dir):
    """Orders as requests under a daily budget in cents."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cost"))
    told = reserve(o, 50_000_000).join(o, "id")
    return told.groupBy(F.to_date("at").alias("day")).agg(F.count_if("granted").alias("granted"), F.count_if(~F.col("granted")).alias("refused"))


#: Whole machine of t05's stream in SQL: `r` goes through a job's commands one by one, `fell` are the deadlines that passed before each.
_TIMED = """WITH RECURSIVE
  c AS (SELECT user_id AS job_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, 'w' || CAST(event_id % 2 AS VARCHAR) AS worker, epoch_us(ts) / 1e6 AS sec,
        CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'claim' WHEN 'click' THEN 'heartbeat' WHEN 'purchase' THEN 'done' ELSE 'error' END AS op FROM events),
  r AS (
    SELECT job_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, '' AS op, false AS accepted, 0e0 AS sec, '' AS status, CAST(NULL AS VARCHAR) AS worker, 0e0 AS until, CAST(0 AS INTEGER) AS attempts, 0e0 AS retry,
           false AS expired, 0e0 AS ended, false AS due, 0e0 AS again FROM c GROUP BY job_id
    UNION ALL
    SELECT job_id, k, seq, op, accepted, sec,
           CASE WHEN NOT accepted THEN s WHEN op = 'enqueue' THEN 'queued' WHEN op IN ('claim', 'heartbeat') THEN 'claimed' WHEN op = 'done' THEN 'done' WHEN attempts >= 3 THEN 'failed' ELSE 'retry_wait' END,
           CASE WHEN NOT accepted THEN owner WHEN op IN ('claim', 'heartbeat') THEN worker END,
           CASE WHEN NOT accepted THEN until WHEN op = 'claim' THEN sec + 7200e0 WHEN op = 'heartbeat' THEN CASE WHEN until - sec <= 3600e0 THEN sec + 7200e0 ELSE until END ELSE 0e0 END,
           CASE WHEN NOT accepted OR op NOT IN ('enqueue', 'claim') THEN attempts WHEN op = 'claim' THEN attempts + 1 ELSE 0 END,
           CASE WHEN NOT accepted THEN retry WHEN op = 'error' AND attempts < 3 THEN sec + least(3600e0, 600e0 * pow(2e0, least(greatest(attempts - 1, 0), 6))) WHEN op = 'heartbeat' THEN retry ELSE 0e0 END,
           expired, ended, due, again
    FROM (
      SELECT *, CASE op WHEN 'enqueue' THEN s IN ('', 'done', 'failed', 'canceled') WHEN 'claim' THEN s = 'queued' ELSE s = 'claimed' AND owner = worker END AS accepted
      FROM (
        SELECT job_id, k, seq, op, worker, sec, attempts, expired, ended, again, s1 = 'retry_wait' AND sec >= again AS due, CASE WHEN s1 = 'retry_wait' AND sec >= again THEN 'queued' ELSE s1 END AS s,
               CASE WHEN s1 = 'claimed' THEN owner END AS owner, CASE WHEN s1 = 'claimed' THEN until ELSE 0e0 END AS until, CASE WHEN s1 = 'retry_wait' AND sec >= again THEN 0e0 ELSE again END AS retry
        FROM (
          SELECT r.job_id, c.k, c.seq, c.op, c.worker, c.sec, r.attempts, r.worker AS owner, r.until, r.until AS ended, r.status = 'claimed' AND c.sec >= r.until AS expired,
                 CASE WHEN r.status = 'claimed' AND c.sec >= r.until THEN CASE WHEN r.attempts >= 3 THEN 'failed' ELSE 'retry_wait' END ELSE r.status END AS s1,
                 CASE WHEN r.status = 'claimed' AND c.sec >= r.until AND r.attempts < 3 THEN r.until + least(3600e0, 600e0 * pow(2e0, least(greatest(r.attempts - 1, 0), 6))) ELSE r.retry END AS again
          FROM r JOIN c ON c.job_id = r.job_id AND c.k = r.k + 1)))),
  done AS MATERIALIZED (SELECT *, lag(attempts) OVER (PARTITION BY job_id ORDER BY k) AS held, max(k) OVER (PARTITION BY job_id) = k AS last FROM r),
  edge AS (SELECT (max(epoch_us(ts)) - 172800000000) / 1e6 AS w FROM events),
  tail AS (
    SELECT job_id, attempts, status = 'claimed' AND until < w AS expired, until AS ended, CASE WHEN status = 'claimed' THEN until + least(3600e0, 600e0 * pow(2e0, least(greatest(attempts - 1, 0), 6))) ELSE retry END AS again,
           status = 'retry_wait' OR (status = 'claimed' AND until < w AND attempts < 3) AS waits, w FROM done, edge WHERE last)
  SELECT job_id, seq, op, accepted, status, attempts, sec AS "at" FROM done WHERE k > 0
  UNION ALL SELECT job_id, NULL, 'lease.expired', true, CASE WHEN held >= 3 THEN 'failed' ELSE 'retry_wait' END, held, ended FROM done WHERE expired
  UNION ALL SELECT job_id, NULL, 'retry.due', true, 'queued', held, again FROM done WHERE due
  UNION ALL SELECT job_id, NULL, 'lease.expired', true, CASE WHEN attempts >= 3 THEN 'failed' ELSE 'retry_wait' END, attempts, ended FROM tail WHERE expired
  UNION ALL SELECT job_id, NULL, 'retry.due', true, 'queued', attempts, again FROM tail WHERE waits AND again < w"""


@query("t05_timed_queue", _TIMED)
def t05(spark, sf_dir):
    """Also r20: leases that run out and retries that fall due by timers, results of leases that ran out refused."""
    rows = commands(streams.table_stream(spark, f"{sf_dir}/events.parquet")).withColumnRenamed("at", "seconds")
    rows = streams.event_time(rows.withColumn("ts", F.timestamp_seconds("seconds")), "ts", _LATE)
    with streams.rocksdb(spark):
        return streams.drain(timers.timed_transitions(rows, lease=7200.0, base=600.0), "timed")


@query("t17_maintenance_ticks", f"""WITH e AS (SELECT user_id AS key, event_id AS seq, epoch_us(ts) AS micros FROM events),
  g AS (SELECT *, CASE WHEN micros - lag(micros) OVER w <= 43200000000 THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY key ORDER BY micros, seq)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY micros, seq ROWS UNBOUNDED PRECEDING) AS s FROM g),
  b AS (SELECT key, s, min(micros) AS first, max(micros) AS last FROM s GROUP BY key, s),
  t AS (SELECT key, s, last, first + 10800000000 * unnest(generate_series(1, (last + 43200000000 - first) // 10800000000)) AS due FROM b)
  SELECT t.key, t.due, max(s.seq) AS after FROM t JOIN s ON s.key = t.key AND s.s = t.s AND s.micros < t.due
  WHERE t.due <= t.last OR t.due < epoch_us({_EDGE}) OR EXISTS (SELECT 1 FROM b WHERE b.key = t.key AND b.s = t.s + 1) GROUP BY t.key, t.due""")
def t17(spark, sf_dir):
    """Also t10: work that is due every three hours while a key is alive, by timers; twelve silent hours end it."""
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.unix_micros("at").alias("micros"), "at")
    hour = 3_600_000_000
    with streams.rocksdb(spark):
        return streams.drain(timers.periodic(rows, 3 * hour, 12 * hour), "ticks")


@query("t09_priority_queue", """WITH RECURSIVE
  c AS (SELECT user_id % 40 AS queue, event_id AS seq, row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) AS k, CASE event_type WHEN 'signup' THEN 'take' WHEN 'error' THEN 'done' ELSE 'offer' END AS op,
        event_id * 7 % 23 AS item, CASE event_type WHEN 'purchase' THEN 80 WHEN 'click' THEN 20 ELSE 10 END AS priority FROM events),
  r AS (
    SELECT queue, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, '' AS op, '' AS answer, CAST(NULL AS BIGINT) AS item, CAST([] AS STRUCT(rank INTEGER, number BIGINT, item BIGINT)[]) AS heap, CAST([] AS BIGINT[]) AS pending FROM c GROUP BY queue
    UNION ALL
    SELECT queue, k, seq, op, answer, CASE answer WHEN 'taken' THEN best.item WHEN 'empty' THEN NULL ELSE item END,
           CASE answer WHEN 'ok' THEN list_append(heap, {'rank': CAST(-priority AS INTEGER), 'number': seq, 'item': item}) WHEN 'taken' THEN list_filter(heap, lambda x: x.number <> best.number) ELSE heap END,
           CASE answer WHEN 'ok' THEN list_append(pending, item) WHEN 'done' THEN list_filter(pending, lambda x: x <> item) ELSE pending END
    FROM (
      SELECT c.*, r.heap, r.pending, list_sort(r.heap)[1] AS best,
             CASE WHEN c.op = 'offer' THEN CASE WHEN list_contains(r.pending, c.item) THEN 'duplicate' WHEN len(r.heap) >= 8 THEN 'full' ELSE 'ok' END WHEN c.op = 'take' THEN CASE WHEN len(r.heap) > 0 THEN 'taken' ELSE 'empty' END
                  WHEN list_contains(r.pending, c.item) AND len(list_filter(r.heap, lambda x: x.item = c.item)) = 0 THEN 'done' ELSE 'unknown' END AS answer
      FROM r JOIN c ON c.queue = r.queue AND c.k = r.k + 1))
  SELECT queue, seq, op, answer, item, CAST(len(heap) AS INTEGER) AS waiting FROM r WHERE k > 0""")
def t09(spark, sf_dir):
    """Bounded heaps as keyed state: duplicates and full queues are refused, highest priority first, oldest first within it."""
    t = F.col("event_type")
    op = F.when(t == "signup", "take").when(t == "error", "done").otherwise("offer")
    rows = streams.table_stream(spark, f"{sf_dir}/events.parquet").select(
        (F.col("user_id") % 40).alias("queue"), F.col("event_id").alias("seq"), op.alias("op"), (F.col("event_id") * 7 % 23).alias("item"), F.when(t == "purchase", 80).when(t == "click", 20).otherwise(10).alias("priority")
    )
    with streams.rocksdb(spark):
        return streams.drain(heap.answers(rows, limit=8), "heap")


@query("s20_incremental_feed", """WITH r AS (SELECT page_id AS seq, page_id AS id, CAST(url AS VARCHAR) AS body FROM pages UNION ALL SELECT 1000000000 + page_id, page_id, url || '?v=2' FROM pages WHERE page_id % 5 = 0
  UNION ALL SELECT 2000000000 + page_id, page_id, NULL FROM pages WHERE page_id % 9 = 4 UNION ALL SELECT 3000000000 + page_id, 500000000 + page_id, url FROM pages WHERE page_id % 7 = 1)
  SELECT id, seq, md5(body) AS body FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) WHERE body IS NOT NULL""")
def s20(spark, sf_dir):
    """A knowledge base synchronised twice by offset, with records changed, deleted and added between."""
    from recallbase.sources import feed

    p, folder = table(spark, sf_dir, "pages"), new_folder(spark, "feed")
    of = lambda rows, first, ids, body: rows.select((F.lit(first) + F.col("page_id")).alias("seq"), (F.lit(ids) + F.col("page_id")).alias("id"), body.alias("body"))
    feed.publish(of(p, 0, 0, F.col("url")), f"{folder}/pages")
    streams.merge_latest(feed.read_stream(spark, f"{folder}/pages"), f"{folder}/sync", "id", "seq")
    feed.publish(of(p.where("page_id % 5 = 0"), 1_000_000_000, 0, F.concat("url", F.lit("?v=2"))), f"{folder}/pages")
    feed.publish(of(p.where("page_id % 9 = 4"), 2_000_000_000, 0, F.lit(None).cast("string")), f"{folder}/pages")
    feed.publish(of(p.where("page_id % 7 = 1"), 3_000_000_000, 500_000_000, F.col("url")), f"{folder}/pages")
    state = streams.merge_latest(feed.read_stream(spark, f"{folder}/pages"), f"{folder}/sync", "id", "seq")
    return state.where("body is not null").select("id", "seq", F.md5(F.col("body").cast("binary")).alias("body"))


@query("t06_fenced_results", sql("""j AS (SELECT id, CASE WHEN status IN ('queued', 'claimed') THEN 'claimed' ELSE status END AS status, id * 7 % 1009 AS token FROM job),
  r AS (SELECT id AS seq, id, CASE WHEN id % 3 = 0 THEN id * 7 % 1009 ELSE id * 7 % 1009 + 1 END AS token, id % 10 <> 0 AS ok FROM job WHERE id % 4 <> 1 UNION ALL SELECT 1000000000 + id, id, id * 7 % 1009, true FROM job WHERE id % 5 < 3),
  m AS (SELECT r.*, j.status = 'claimed' AND r.token = j.token AS fits FROM r JOIN j USING (id)),
  e AS (SELECT id, min(seq) FILTER (fits) AS accepted_seq, arg_min(ok, seq) FILTER (fits) AS ok, count(*) AS n FROM m GROUP BY id)
  SELECT j.id, CASE WHEN accepted_seq IS NULL THEN status WHEN ok THEN 'done' ELSE 'failed' END AS status, CASE WHEN accepted_seq IS NOT NULL THEN 'r' || CAST(accepted_seq AS VARCHAR) END AS result, accepted_seq,
         coalesce(n, 0) - CASE WHEN accepted_seq IS NULL THEN 0 ELSE 1 END AS refused FROM j LEFT JOIN e USING (id)""", "job"))
def t06(spark, sf_dir):
    """Results with right, stale and repeated tokens, in four batches; a second one for a job may come batches after the first."""
    from recallbase.streaming import fenced

    j = views.job(spark, sf_dir).select("id", F.when(F.col("status").isin("queued", "claimed"), "claimed").otherwise(F.col("status")).alias("status"), (F.col("id") * 7 % 1009).alias("token"))
    first = j.where("id % 4 <> 1").select(F.col("id").alias("seq"), "id", F.when(F.col("id") % 3 == 0, F.col("token")).otherwise(F.col("token") + 1).alias("token"), (F.col("id") % 10 != 0).alias("ok"))
    again = j.where("id % 5 < 3").select((F.lit(1_000_000_000) + F.col("id")).alias("seq"), "id", "token", F.lit(True).alias("ok"))
    folder = new_folder(spark, "fenced")
    for part in (first, again):  # two files each, the later ones after the others
        part.withColumn("result", F.concat(F.lit("r"), F.col("seq").cast("string"))).repartition(2).write.mode("append").parquet(f"{folder}/results")
    jobs = j.withColumn("result", F.lit(None).cast("string")).withColumn("accepted_seq", F.lit(None).cast("long")).withColumn("refused", F.lit(0).cast("long"))
    return fenced.apply_results(streams.table_stream(spark, f"{folder}/results", files_per_batch=1), jobs, folder).select("id", "status", "result", "accepted_seq", "refused")
