"""Memory lifecycle, graphs, state folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recallbase.functions import exprs as X
from recallbase.operators import graph as G
from recallbase.operators import lifecycle as L
from recallbase.plans import views
from recallbase.plans.registry import query
from recallbase.plans.views import sql
from recallbase.session import table

_AGE = "CAST(date_diff('microsecond', created_at, TIMESTAMP '2024-02-15 00:00:00') AS DOUBLE) / 86400000000e0"
_UTILITY = f"0.30e0 * exp(-greatest({_AGE}, 0e0) / 30) + 0.20e0 * least(1e0, ln(1 + CAST(access_count AS DOUBLE)) / 4) + 0.20e0 * least(greatest(salience / 2, 0e0), 1e0) + 0.20e0 * least(greatest(confidence, 0e0), 1e0) + 0.10e0 * least(greatest((reward + 1) / 2, 0e0), 1e0)"
_NOW = "2024-02-15 00:00:00"


@query("m04_conflict_resolution", sql("""r AS (SELECT id, lower(truth_key) AS key, version, created_at, status, sha256(lower(trim(text))) AS h, CAST(round((0.55e0 * confidence + 0.25e0 * least(greatest((reward + 1) / 2, 0e0), 1e0) + 0.20e0 * least(greatest(salience / 2, 0e0), 1e0)) * 1e9) AS BIGINT) AS score FROM memory),
  live AS (SELECT *, max(version) OVER (PARTITION BY key) AS newest FROM r WHERE status <> 'archived'), top AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY created_at, id) AS n FROM live WHERE version = newest),
  later AS (SELECT j.id, arg_max(CASE WHEN i.h = j.h OR i.score - j.score >= 150000000 THEN 'superseded' ELSE 'conflicted' END, i.n) AS s FROM top j JOIN top i ON i.key = j.key AND i.n > j.n WHERE i.h = j.h OR i.score - j.score > -150000000 GROUP BY j.id),
  own AS (SELECT i.id, arg_max(CASE WHEN i.score - j.score > -150000000 THEN 'conflicted' ELSE 'superseded' END, j.n) AS s FROM top i JOIN top j ON i.key = j.key AND j.n < i.n WHERE NOT (i.h = j.h OR i.score - j.score >= 150000000) GROUP BY i.id)
  SELECT t.id, coalesce(l.s, o.s, t.status) AS new_status FROM top t LEFT JOIN later l ON l.id = t.id LEFT JOIN own o ON o.id = t.id UNION ALL SELECT id, 'superseded' FROM live WHERE version < newest UNION ALL SELECT id, status FROM r WHERE status = 'archived'""", "memory"))
def m04(spark, sf_dir):
    return L.resolve_conflicts(views.memory(spark, sf_dir)).select("id", "new_status")


@query("m05_manual_resolution", sql("SELECT id, CASE WHEN truth_key <> 'truth-7' THEN status WHEN id = 67 THEN 'active' ELSE 'superseded' END AS status FROM memory", "memory"))
def m05(spark, sf_dir):
    return L.resolve_manually(views.memory(spark, sf_dir), "truth-7", 67).select("id", "status")


@query("m06_corroborate", sql("""e AS (SELECT memory_id AS id, source_id, max(value / 1000e0) AS w FROM research_event WHERE type = 'evidence.corroborated' AND value < 1000 GROUP BY memory_id, source_id),
  t AS (SELECT id, exp(sum(ln(1 - 0.35e0 * w))) AS l, sum(w) AS w, count(*) AS n FROM e GROUP BY id)
  SELECT m.id, round(CASE WHEN l IS NULL THEN confidence ELSE 1 - (1 - confidence) * l END, 9) AS confidence, round(least(2.5e0, salience + 0.04e0 * coalesce(w, 0e0)), 9) AS salience, coalesce(n, 0) AS sources FROM memory m LEFT JOIN t ON t.id = m.id""", "memory", "research_event"))
def m06(spark, sf_dir):
    e = views.research_event(spark, sf_dir).where("type = 'evidence.corroborated' AND value < 1000").select(F.col("memory_id").alias("id"), "source_id", (F.col("value") / 1000).alias("weight"))
    return L.corroborate(views.memory(spark, sf_dir), e).select("id", F.round("confidence", 9).alias("confidence"), F.round("salience", 9).alias("salience"), "sources")


@query("m07_reinforce_edges", """WITH RECURSIVE e AS (SELECT least(user_id % 40, event_id % 37) AS a, greatest(user_id % 40, event_id % 37) + 1 AS b, event_id, event_id // 400 AS at_day, value / 500e0 AS delta FROM events),
  n AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY at_day, delta) AS k FROM e),
  f AS (SELECT a, b, k, CAST(at_day AS DOUBLE) AS d, greatest(-1e0, least(1e0, delta)) AS w FROM n WHERE k = 1
    UNION ALL SELECT n.a, n.b, n.k, CAST(n.at_day AS DOUBLE), greatest(-1e0, least(1e0, f.w * pow(0.98e0, n.at_day - f.d) + n.delta)) FROM f JOIN n ON n.a = f.a AND n.b = f.b AND n.k = f.k + 1)
  SELECT a, b, round(arg_max(w, k), 6) AS weight, max(k) AS activations FROM f GROUP BY a, b""")
def m07(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.least(F.expr("user_id % 40"), F.expr("event_id % 37")).alias("a"), (F.greatest(F.expr("user_id % 40"), F.expr("event_id % 37")) + 1).alias("b"), F.expr("event_id div 400").alias("at_day"), (F.col("value") / 500).alias("delta"))
    return L.reinforce(e, 0.02, 1.0).select("a", "b", F.round("weight", 6).alias("weight"), F.col("activations").cast("long").alias("activations"))


@query("m08_edge_evidence", """WITH e AS (SELECT least(user_id, event_id % 100) AS a, greatest(user_id, event_id % 100) AS b, event_type AS relation, value FROM events)
  SELECT a, b, round(least(0.9e0, max(value / 100e0)), 9) AS weight, round(max(value / 200e0), 9) AS similarity, array_to_string(list_sort(list(DISTINCT relation)), ',') AS relations, count(DISTINCT relation) AS activations FROM e GROUP BY a, b""")
def m08(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("a"), F.expr("event_id % 100").alias("b"), F.col("event_type").alias("relation"), (F.col("value") / 200).alias("similarity"), (F.col("value") / 100).alias("weight"))
    return L.edge_evidence(e, 0.9).select("a", "b", F.round("weight", 9).alias("weight"), F.round("similarity", 9).alias("similarity"), F.array_join("relations", ",").alias("relations"), F.col("activations").cast("long").alias("activations"))


@query("m09_decay_edges", sql("d AS (SELECT a, b, weight * pow(0.98e0, CAST((a + b) % 60 AS DOUBLE)) AS w FROM synapse) SELECT a, b, round(w, 9) AS weight FROM d WHERE w >= 0.2e0", "synapse"))
def m09(spark, sf_dir):
    return L.decay_edges(views.synapse(spark, sf_dir), ((F.col("a") + F.col("b")) % 60).cast("double"), 0.02, 0.2).select("a", "b", F.round("weight", 9).alias("weight"))


@query("m10_touch", sql("""t AS (SELECT memory_id AS id, count(*) AS n FROM research_event WHERE type = 'search.result' GROUP BY memory_id) SELECT m.id, access_count + coalesce(n, 0) AS access_count, CASE WHEN n IS NULL THEN created_at ELSE TIMESTAMP '2024-02-15' END AS accessed_at FROM memory m LEFT JOIN t ON t.id = m.id""", "memory", "research_event"))
def m10(spark, sf_dir):
    t = views.research_event(spark, sf_dir).where("type = 'search.result'").select(F.col("memory_id").alias("id"))
    return L.touch(views.memory(spark, sf_dir).withColumn("accessed_at", F.col("created_at")), t, F.lit(_NOW).cast("timestamp_ntz")).select("id", "access_count", "accessed_at")


@query("m11_retention", sql(f"""u AS (SELECT id, memory_type, status, {_AGE} AS age, {_UTILITY} AS utility FROM memory), s AS (SELECT *, CASE WHEN memory_type = 'working' AND age * 24 >= 600 THEN 'delete_ttl' WHEN age >= 20 AND utility < 0.45e0 AND status <> 'archived' THEN 'archive' ELSE 'keep' END AS action FROM u),
  c AS (SELECT greatest(count(*) - 150, 0) AS need FROM s WHERE action <> 'delete_ttl'), r AS (SELECT id, row_number() OVER (ORDER BY utility, id) AS n FROM s WHERE action <> 'delete_ttl' AND memory_type <> 'procedural')
  SELECT s.id, CASE WHEN r.n <= c.need THEN 'delete_cap' ELSE action END AS action, round(utility, 9) AS utility FROM s CROSS JOIN c LEFT JOIN r ON r.id = s.id""", "memory"))
def m11(spark, sf_dir):
    return L.retention(views.memory(spark, sf_dir), _NOW, 600, 20, 0.45, 150).select("id", "action", F.round("utility", 9).alias("utility"))


@query("m23_tiering", sql(f"""r AS (SELECT id, length(text) AS bytes, created_at, {_AGE} > 40 AS old, sum(length(text)) OVER (ORDER BY CAST(created_at AS DATE) DESC, created_at DESC, id) AS run FROM memory) SELECT id, old OR run > 500000 AS cold FROM r""", "memory"))
def m23(spark, sf_dir):
    m = views.memory(spark, sf_dir, "CAST(length(text) AS BIGINT)").select("id", F.col("text").alias("bytes"), F.col("created_at").alias("accessed_at"))
    return L.tiering(m, 500_000, X.age_days(F.col("accessed_at"), _NOW), 40)


@query("m03_batch_delete", sql("""k AS (SELECT id FROM memory WHERE id % 9 <> 0) SELECT 'memory' AS kind, count(*) AS n FROM k UNION ALL SELECT 'edge', count(*) FROM synapse WHERE a NOT IN (SELECT id FROM memory WHERE id % 9 = 0) AND b NOT IN (SELECT id FROM memory WHERE id % 9 = 0)""", "memory", "synapse"))
def m03(spark, sf_dir):
    m = views.memory(spark, sf_dir).select("id")
    a, b = L.delete(m, views.synapse(spark, sf_dir), m.where("id % 9 = 0"))
    return a.agg(F.count("*").alias("n")).select(F.lit("memory").alias("kind"), "n").union(b.agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "n"))


@query("m01_insert_with_defaults", """SELECT c.conv_id * 100 + turn AS id, 1e0 AS salience, 1e0 AS confidence, CASE WHEN role IN ('user', 'assistant') THEN 'episodic' ELSE 'semantic' END AS memory_type, 'active' AS status, 1 AS version FROM conversations c""")
def m01(spark, sf_dir):
    null = lambda kind: F.lit(None).cast(kind)
    new = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("role").alias("kind"), F.lit(0.0).alias("salience"), null("double").alias("confidence"), F.lit("").alias("memory_type"), null("string").alias("status"), F.lit(0).alias("version"))
    return L.with_defaults(new).select("id", "salience", "confidence", "memory_type", "status", "version")


@query("w12_revision_chain", """WITH o AS (SELECT event_id AS id, user_id AS run_id, ts AS happened, event_type AS decision, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events), k AS (SELECT * FROM o WHERE before IS NULL OR decision <> before)
  SELECT id, run_id, lag(id) OVER (PARTITION BY run_id ORDER BY happened, id) AS supersedes FROM k""")
def w12(spark, sf_dir):
    o = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("run_id"), F.col("ts").alias("at"), F.col("event_type").alias("decision"))
    return L.revision_chain(o).select("id", "run_id", "supersedes")


@query("w13_replace_by_run", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, event_id, event_type FROM r WHERE n = 1""")
def w13(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("at"))
    return L.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "at").select("user_id", "event_id", "event_type")


@query("s09_segment_latest_wins", """WITH l AS (SELECT o_custkey AS id, o_orderkey AS revision, o_orderstatus = 'P' AS deleted, o_totalprice AS price FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY revision DESC) AS n FROM l) SELECT id, revision, price FROM r WHERE n = 1 AND NOT deleted""")
def s09(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("revision"), (F.col("o_orderstatus") == "P").alias("deleted"), F.col("o_totalprice").alias("price"))
    return L.fold_log(log, "id", "revision", "deleted").select("id", "revision", "price")


@query("s07_wal_replay", """WITH l AS (SELECT o_custkey AS id, o_orderkey AS revision, o_orderstatus = 'F' AND o_orderkey % 5 = 0 AS deleted, o_orderstatus AS state FROM orders WHERE o_orderkey > 3000), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY revision DESC) AS n FROM l) SELECT id, revision, state FROM r WHERE n = 1 AND NOT deleted""")
def s07(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("revision"), ((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 5 == 0)).alias("deleted"), F.col("o_orderstatus").alias("state"))
    return L.fold_log(log, "id", "revision", "deleted", after=F.lit(3000)).select("id", "revision", "state")


@query("g05_degree", sql("b AS (SELECT a, b FROM synapse UNION ALL SELECT b, a FROM synapse) SELECT a AS id, count(DISTINCT b) AS degree FROM b GROUP BY a", "synapse"))
def g05(spark, sf_dir):
    return G.degrees(views.synapse(spark, sf_dir))


@query("g03_components", """WITH RECURSIVE e AS (SELECT vec_id AS a, vec_id + 5 AS b FROM embeddings WHERE vec_id + 5 IN (SELECT vec_id FROM embeddings) AND vec_id % 11 < 4), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  r AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id) SELECT id, min(c) AS component FROM r GROUP BY id""")
def g03(spark, sf_dir):
    n = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    e = n.where("id % 11 < 4").select(F.col("id").alias("a"), (F.col("id") + 5).alias("b")).join(n.withColumnRenamed("id", "b"), "b", "left_semi")
    return G.connected(n, e)


@query("a04_graph_stats", sql("""x AS (SELECT a, b FROM synapse WHERE weight >= 0.75e0), u AS (SELECT a, b FROM x UNION ALL SELECT b, a FROM x), d AS (SELECT e.vec_id AS id, (SELECT count(DISTINCT b) FROM u WHERE u.a = e.vec_id) AS degree FROM embeddings e)
  SELECT count(*) AS nodes, count(*) FILTER (degree = 0) AS isolated, count(*) FILTER (degree > 1) AS multi_linked, max(degree) AS max_degree, round(avg(degree), 9) AS avg_degree, (SELECT count(*) FROM x) AS edges FROM d""", "synapse"))
def a04(spark, sf_dir):
    n = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return G.statistics(n, views.synapse(spark, sf_dir).where("weight >= 0.75")).select("nodes", "isolated", "multi_linked", "max_degree", F.round("avg_degree", 9).alias("avg_degree"), "edges")


@query("g01_multihop_expansion", sql("""u AS (SELECT a, b, weight FROM synapse WHERE weight >= 0.3e0 UNION ALL SELECT b, a, weight FROM synapse WHERE weight >= 0.3e0), ok AS (SELECT id FROM memory WHERE status IN ('active', 'conflicted')),
  h1 AS (SELECT q.id AS query_id, u.b AS id, max(0.2e0 * u.weight) AS boost FROM memory q JOIN u ON u.a = q.id JOIN ok ON ok.id = u.b WHERE q.id < 10 GROUP BY q.id, u.b),
  h2 AS (SELECT query_id, u.b AS id, max(boost * (u.weight * 0.6e0)) AS boost FROM h1 JOIN u ON u.a = h1.id JOIN ok ON ok.id = u.b GROUP BY query_id, u.b)
  SELECT query_id, id, round(max(boost), 9) AS boost FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY query_id, id""", "memory", "synapse"))
def g01(spark, sf_dir):
    m = views.memory(spark, sf_dir).select("id", "status")
    seeds = m.where("id < 10").select(F.col("id").alias("query_id"), "id")
    return G.expand(seeds, views.synapse(spark, sf_dir), m.where(X.searchable(F.col("status"))), 0.2, 2, 0.6, 0.3).withColumn("boost", F.round("boost", 9))


@query("g04_knowledge_subgraph", sql("""p AS (SELECT id, round(salience + 0.01e0 * access_count, 9) AS priority FROM memory ORDER BY priority DESC, id LIMIT 60) SELECT a, b, round(weight, 9) AS weight FROM synapse WHERE a IN (SELECT id FROM p) AND b IN (SELECT id FROM p) ORDER BY weight DESC, a, b LIMIT 240""", "memory", "synapse"))
def g04(spark, sf_dir):
    m = views.memory(spark, sf_dir)
    _, e = G.subgraph(m.select("id", "salience", "access_count"), views.synapse(spark, sf_dir), F.round(F.col("salience") + 0.01 * F.col("access_count"), 9), 60)
    return e.select("a", "b", F.round("weight", 9).alias("weight"))


@query("g07_blast_radius", """WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, 1000000 + l_suppkey AS b FROM lineitem WHERE l_quantity >= 49), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  r AS (SELECT p_partkey AS id, 0 AS d FROM part WHERE p_partkey IN (3, 11) UNION SELECT u.b, r.d + 1 FROM r JOIN u ON u.a = r.id WHERE r.d < 3) SELECT id, min(d) AS depth FROM r GROUP BY id""")
def g07(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000).alias("b")).distinct()
    return G.reachable(table(spark, sf_dir, "part").where("p_partkey IN (3, 11)").select(F.col("p_partkey").alias("id")), e, 3)


@query("g12_research_lineage", sql("""n AS (SELECT 'goal:' || goal_id AS id, 'goal' AS kind FROM research_event UNION SELECT 'run:' || run_id, 'run' FROM research_event UNION SELECT 'source:' || source_id, 'source' FROM research_event WHERE type LIKE 'evidence.%' UNION SELECT 'memory:' || memory_id, 'memory' FROM research_event WHERE type LIKE 'evidence.%'),
  e AS (SELECT 'goal:' || goal_id AS f, 'run:' || run_id AS t FROM research_event UNION SELECT 'run:' || run_id, 'source:' || source_id FROM research_event WHERE type LIKE 'evidence.%' UNION SELECT 'source:' || source_id, 'memory:' || memory_id FROM research_event WHERE type LIKE 'evidence.%')
  SELECT 'node' AS what, kind, count(*) AS n FROM n GROUP BY kind UNION ALL SELECT 'edge', split_part(f, ':', 1), count(*) FROM e GROUP BY 2""", "research_event"))
def g12(spark, sf_dir):
    nodes, edges = research_lineage(views.research_event(spark, sf_dir))
    return nodes.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "kind", "n").union(edges.groupBy(F.substring_index("from", ":", 1).alias("kind")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "kind", "n"))


def research_lineage(events):
    """Nodes and edges goal -> run -> source -> memory of a research trace."""
    name = lambda kind, col: F.concat(F.lit(kind + ":"), F.col(col).cast("string"))
    node = lambda rows, kind, col: rows.select(name(kind, col).alias("id"), F.lit(kind).alias("kind"), F.col(col).cast("string").alias("label"))
    edge = lambda rows, a, ac, b, bc, kind: rows.select(name(a, ac).alias("from"), name(b, bc).alias("to"), F.lit(kind).alias("kind"))
    found = events.where("type LIKE 'evidence.%'")
    return G.lineage([
        (node(events, "goal", "goal_id"), edge(events, "goal", "goal_id", "run", "run_id", "runs")), (node(events, "run", "run_id"), edge(found, "run", "run_id", "source", "source_id", "uses")),
        (node(found, "source", "source_id"), edge(found, "source", "source_id", "memory", "memory_id", "supports")), (node(found, "memory", "memory_id"), None),
    ])


@query("j08_detail_star", sql("""u AS (SELECT a, b, weight FROM synapse UNION ALL SELECT b, a, weight FROM synapse), r AS (SELECT a, b, weight, row_number() OVER (PARTITION BY a ORDER BY weight DESC, b) AS n FROM u WHERE a < 50)
  SELECT m.id, m.kind, count(r.b) AS edges, round(coalesce(max(r.weight), 0e0), 9) AS strongest, (SELECT count(*) FROM research_event e WHERE e.memory_id = m.id) AS events FROM memory m LEFT JOIN r ON r.a = m.id AND r.n <= 50 WHERE m.id < 50 GROUP BY m.id, m.kind""", "memory", "synapse", "research_event"))
def j08(spark, sf_dir):
    m = views.memory(spark, sf_dir).where("id < 50").select("id", "kind")
    e = G.top_edges(views.synapse(spark, sf_dir), 50).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("edges"), F.max("weight").alias("strongest"))
    ev = views.research_event(spark, sf_dir).groupBy(F.col("memory_id").alias("id")).agg(F.count("*").alias("events"))
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return m.join(e, "id", "left").join(ev, "id", "left").select("id", "kind", zero("edges", 0), F.round(F.coalesce("strongest", F.lit(0.0)), 9).alias("strongest"), zero("events", 0))


@query("w03_source_diversity", sql("""r AS (SELECT id, source, row_number() OVER (ORDER BY salience DESC, id) AS rank FROM memory WHERE status = 'active'), s AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank) AS rn FROM r) SELECT id, source, rn FROM s WHERE rn <= 2 ORDER BY rn, rank LIMIT 30""", "memory"))
def w03(spark, sf_dir):
    w = Window.partitionBy("source").orderBy(F.desc("salience"), "id")
    return views.memory(spark, sf_dir).where("status = 'active'").withColumn("rn", F.row_number().over(w).cast("long")).where("rn <= 2").orderBy("rn", F.desc("salience"), "id").limit(30).select("id", "source", "rn")


@query("w08_examples_per_category", sql("""r AS (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY created_at DESC, id) AS n FROM memory) SELECT label, array_to_string(list(CAST(id AS VARCHAR) ORDER BY n), ',') AS ids FROM r WHERE n <= 4 GROUP BY label""", "memory"))
def w08(spark, sf_dir):
    w = Window.partitionBy("label").orderBy(F.desc("created_at"), "id")
    r = views.memory(spark, sf_dir).select("label", F.col("id").cast("string").alias("id"), F.row_number().over(w).alias("n")).where("n <= 4")
    return r.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]), ",").alias("ids"))


@query("w14_consolidation")
def w14(spark, sf_dir):
    """All memories that a search may return, over all edges; a test compares with a plain loop."""
    edges = views.synapse(spark, sf_dir).select("a", "b", F.col("weight").alias("similarity"))
    return L.consolidate(views.memory(spark, sf_dir).where(X.searchable(F.col("status"))), edges, 2, 6)
