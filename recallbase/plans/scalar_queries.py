"""Scalar columns over whole tables, several inventory entries a query."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallbase.functions import exprs as X
from recallbase.functions import text as T
from recallbase.plans import views
from recallbase.plans.registry import query
from recallbase.plans.views import sql
from recallbase.session import table

_FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query("c14_text_shapes", rf"""SELECT doc_id, trim(regexp_replace(lower(trim(regexp_extract('Root > Sub/' || source || ' Größe', '([^>/]*)$', 1))), '[^a-z0-9]+', ' ', 'g')) AS raw_leaf,
  'task: search result | query: ' || trim(lang) AS prompt, 'title: none | text: ' || trim(lang) AS doc_prompt, replace(text, 'the', 'THE') AS swapped, regexp_replace(text, '(?i)th(e|a)', 'T\1', 'g') AS pattern, regexp_replace(text, '(?i)the', '$0', 'g') AS folded,
  greatest(1, CAST(floor(length(text) / 4) AS BIGINT)) AS tokens FROM documents""")
def c14(spark, sf_dir):
    """c14, c16, c17, c30: leaf of a category path (umlauts are spelled out elsewhere), prompts, find and replace, token estimate."""
    d, t = table(spark, sf_dir, "documents"), F.col("text")
    leaf = T.category_leaf(F.concat(F.lit("Root > Sub/"), "source", F.lit(" Größe")))
    return d.select(
        "doc_id", F.replace(leaf, F.lit("groesse"), F.lit("gr e")).alias("raw_leaf"), T.embedding_prompt(F.col("lang"), "embeddinggemma").alias("prompt"), T.embedding_prompt(F.col("lang"), "embeddinggemma", F.lit(" ")).alias("doc_prompt"),
        T.find_replace(t, "the", "THE", case_sensitive=True).alias("swapped"), T.find_replace(t, "th(e|a)", "T$1", regex=True).alias("pattern"), T.find_replace(t, "the", "$0").alias("folded"), X.token_estimate(t).alias("tokens"),
    )


@query("c15_query_split", """WITH x AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents)
  SELECT doc_id, CASE WHEN contains(t, chr(10)) THEN trim(split_part(t, chr(10), 1)) ELSE t END AS head, CASE WHEN contains(t, chr(10)) THEN regexp_replace(substring(t, strpos(t, chr(10)) + 1), '^\\s+|\\s+$', '', 'g') ELSE t END AS body FROM x""")
def c15(spark, sf_dir):
    head, body = T.split_query(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", head.alias("head"), body.alias("body"))


@query("c22_domains", r"""WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages)
  SELECT page_id, host, host = 'example.org' OR ends_with(host, '.example.org') AS below, CASE WHEN page_id % 4 = 0 THEN NULL ELSE host END AS valid FROM h""")
def c22(spark, sf_dir):
    """c21, c22: domains held against a configured one, and the plain form of valid ones."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1).alias("host"))
    raw = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("-"), "host")).when(F.col("page_id") % 4 == 1, F.concat(F.lit("*."), F.upper("host"), F.lit("."))).otherwise(F.col("host"))
    return p.select("page_id", "host", T.domain_matches(F.col("host"), "*.example.org.").alias("below"), T.valid_domain(raw).alias("valid"))


@query("c24_research_queries", r"""WITH g AS (SELECT conv_id, regexp_extract(text, '^\s*(\S+)', 1) AS title FROM conversations WHERE turn = 0)
  SELECT conv_id, title, list_sort(list_distinct(list_filter([title, title || ' site:docs.example.org'], lambda x: x <> '' AND title <> '')))::VARCHAR[] AS queries FROM g""")
def c24(spark, sf_dir):
    """c24, r10: with a limit of two; a test covers the words of the description."""
    g = table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", F.regexp_extract("text", r"^\s*(\S+)", 1).alias("title"), "text")
    return g.select("conv_id", "title", F.array_sort(T.research_queries(F.col("title"), F.col("text"), F.lit("docs.example.org"), 2)).alias("queries"))


@query("f12_query_usefulness", r"""WITH q AS (SELECT conv_id, turn, text, regexp_extract(text, '(\S+)', 1) AS subject, CASE WHEN turn % 3 = 1 THEN 'next cycle ' ELSE '' END || text AS q FROM conversations),
  w AS (SELECT *, regexp_replace(lower(subject), '^[.,:;!?()\[\]{}"''/_-]+|[.,:;!?()\[\]{}"''/_-]+$', '', 'g') AS s FROM q)
  SELECT conv_id, turn, strlen(lower(trim(q))) >= 3 AND turn % 3 <> 1 AND (trim(subject) = '' OR (length(s) >= 3 AND s NOT IN ('diese', 'dieser', 'soll', 'system', 'with', 'from', 'that', 'this', 'about', 'über', 'neue', 'neuen') AND contains(lower(trim(q)), s))) AS useful FROM w""")
def f12(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    q = F.concat(F.when(F.col("turn") % 3 == 1, "next cycle ").otherwise(""), "text")
    return c.select("conv_id", "turn", T.query_useful(q, F.regexp_extract("text", r"(\S+)", 1)).alias("useful"))


@query("c25_statements", r"""WITH l AS (SELECT doc_id, trim(regexp_replace(regexp_replace(trim(x), '^[#*\-0-9. )\t]+', ''), '\s+', ' ', 'g')) AS s, n FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\r?\n')) AS x, unnest(generate_series(1, len(regexp_split_to_array(text, '\r?\n')))) AS n FROM documents)),
  f AS (SELECT doc_id, s, n, row_number() OVER (PARTITION BY doc_id, lower(s) ORDER BY n) AS k FROM l WHERE length(s) >= 28), r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS place FROM f WHERE k = 1)
  SELECT doc_id, CAST(place AS INTEGER) AS place, s AS statement, contains(lower(s), 'command') OR contains(lower(s), 'upgrade') OR contains(lower(s), 'backup') OR contains(s, '`') OR contains(lower(s), 'sollte') OR contains(lower(s), 'muss') OR contains(lower(s), 'befehl') OR contains(lower(s), 'empfohlen') AS actionable FROM r WHERE place <= 12""")
def c25(spark, sf_dir):
    """c25, r12."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.statements(F.col("text"), 12)).alias("n", "s"))
    return d.select("doc_id", (F.col("n") + 1).alias("place"), F.col("s.text").alias("statement"), F.col("s.actionable").alias("actionable"))


@query("c26_lenient_times", """SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL WHEN 3 THEN NULL ELSE date_trunc('second', ts) END AS at, CASE WHEN event_id % 5 = 4 THEN DATE '2000-01-01' ELSE CAST(ts AS DATE) END AS day FROM events""")
def c26(spark, sf_dir):
    """c26, c27: times in several forms, dates with a fallback."""
    k, ts = F.col("event_id") % 5, F.col("ts")
    form = lambda f: F.date_format(ts, f)
    raw = F.when(k == 0, form("yyyy-MM-dd HH:mm:ss")).when(k == 1, form("yyyy-MM-dd'T'HH:mm:ss")).when(k == 2, F.concat(form("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(k == 3, form("yyyy-MM-dd")).otherwise("soon")
    day = F.coalesce(F.try_to_date(F.substring(raw, 1, 10), "yyyy-MM-dd"), F.lit("2000-01-01").cast("date"))
    return table(spark, sf_dir, "events").select("event_id", T.any_time(raw).cast("timestamp_ntz").alias("at"), day.alias("day"))


@query("c36_memory_scalars", sql("""SELECT id, CASE WHEN kind = 'kind-0' THEN 'procedural' WHEN kind = 'kind-1' THEN 'episodic' ELSE 'semantic' END AS inferred, least(greatest(CASE WHEN confidence - 0.5e0 > 0 THEN confidence - 0.5e0 ELSE 1e0 END * 0.8e0, 0e0), 1e0) AS policy,
  least(id, 7) AS low, greatest(id, 7) AS high, salience * pow(0.9e0, CAST(access_count AS DOUBLE)) AS faded, least(greatest(reward, -0.5e0), 0.5e0) AS held, length(trim(text)) <= 800 AS short, regexp_matches(kind, '^[A-Za-z0-9_.:-]{1,128}$') AS named,
  CASE WHEN memory_type IN ('episodic') THEN 0.85e0 ELSE 0.70e0 END AS trust FROM memory""", "memory"))
def c36(spark, sf_dir):
    """c28, c29, c35, c36, c37, f07, f18, r09: types by kind, confidence by trust, edge ends, decay, clamps, length and name rules."""
    m, c = views.memory(spark, sf_dir), F.col
    kind = F.when(c("kind") == "kind-0", "procedure").when(c("kind") == "kind-1", "Event ").otherwise("note")
    low, high = X.edge_ends(c("id"), F.lit(7))
    return m.select(
        "id", X.memory_type_of(kind).alias("inferred"), X.policy_confidence(c("confidence") - 0.5, F.lit(0.8)).alias("policy"), low.alias("low"), high.alias("high"), X.decayed(c("salience"), 0.1, c("access_count").cast("double")).alias("faded"),
        X.clamp(c("reward"), -0.5, 0.5).alias("held"), (F.length(F.trim("text")) <= 800).alias("short"), c("kind").rlike("^[A-Za-z0-9_.:-]{1,128}$").alias("named"), F.when(c("memory_type") == "episodic", 0.85).otherwise(0.70).alias("trust"),
    )


@query("c42_useful_tokens", r"""WITH w AS (SELECT conv_id, turn, regexp_replace(x, '^[.,;:!?()\[\]{}"'']+|[.,;:!?()\[\]{}"'']+$', '', 'g') AS x, n FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(trim(text), '\s+')) AS x, unnest(generate_series(1, len(regexp_split_to_array(trim(text), '\s+')))) AS n FROM conversations)),
  f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n) AS k FROM w WHERE strlen(x) >= 5 OR (strlen(x) >= 3 AND starts_with(lower(x), '0x'))), u AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, lower(x) ORDER BY n) AS again FROM f WHERE k <= 6)
  SELECT conv_id, turn, string_agg(x, ' ' ORDER BY x COLLATE "C") AS tokens FROM u WHERE again = 1 GROUP BY conv_id, turn""".replace(' COLLATE "C"', ""))
def c42(spark, sf_dir):
    t = T.useful_tokens(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.alias("t")).where(F.size("t") > 0).select("conv_id", "turn", F.array_join("t", " ").alias("tokens"))


@query("c45_templates", "SELECT doc_id, 'Störung ' || source || ': ' || lang || ' seit ' || n_chars || ', ' || source AS text FROM documents")
def c45(spark, sf_dir):
    template = F.lit("Störung {{monitor}}: {{status}} seit {{minutes}}, {{monitor}}")
    return table(spark, sf_dir, "documents").select("doc_id", T.render(template, {"monitor": F.col("source"), "status": F.col("lang"), "minutes": F.col("n_chars")}).alias("text"))


@query("r15_claim_preview", rf"""SELECT doc_id, CASE WHEN regexp_extract({_FLAT}, '^(.{{60,259}}?[.!?])', 1) <> '' THEN regexp_extract({_FLAT}, '^(.{{60,259}}?[.!?])', 1) WHEN length({_FLAT}) > 260 THEN substring({_FLAT}, 1, 260) || '…' ELSE {_FLAT} END AS preview FROM documents""")
def r15(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.claim_preview(F.col("text")).alias("preview"))


@query("c41_summaries", rf"""WITH f AS (SELECT source, CASE WHEN length({_FLAT}) > 320 THEN substring({_FLAT}, 1, 320) || '…' ELSE {_FLAT} END AS line, {_FLAT} AS flat, doc_id FROM documents WHERE {_FLAT} <> ''),
  u AS (SELECT source, line, row_number() OVER (PARTITION BY source, flat ORDER BY doc_id) AS n, doc_id FROM f), r AS (SELECT source, line, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM u WHERE n = 1)
  SELECT source, md5('Consolidated memory:' || chr(10) || string_agg('- ' || line, chr(10) ORDER BY doc_id)) AS summary FROM r WHERE k <= 20 GROUP BY source""")
def c41(spark, sf_dir):
    """c41: summaries of clusters of bounded size, here the first 20 distinct texts of a source."""
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents").withColumn("flat", F.trim(F.regexp_replace("text", r"\s+", " "))).where("flat <> ''")
    first = d.groupBy("source", "flat").agg(F.min("doc_id").alias("doc_id"))
    near = Window.partitionBy("source").orderBy("doc_id")
    kept = first.withColumn("k", F.row_number().over(near)).where("k <= 20").groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "flat"))), lambda x: x["flat"]).alias("texts"))
    return kept.select("source", F.md5(T.summary_lines(F.col("texts"))).alias("summary"))


@query("d01_array_sets", r"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS v FROM conversations)
  SELECT conv_id, turn, (SELECT count(DISTINCT lower(x)) FROM (SELECT unnest(v) AS x) WHERE lower(x) <> 'the') AS folded, len(list_distinct(v)) AS plain, len(list_filter(v, lambda x: x NOT IN ('the', 'of'))) = 0 AS all_allowed FROM w""")
def d01(spark, sf_dir):
    """d01, d02, d03, d09, d11, d12: ordered distinct, without regard to case, removals, subset tests."""
    v = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(T.distinct_folded(v, ["The "])).cast("long").alias("folded"), F.size(F.array_distinct(v)).cast("long").alias("plain"), (F.size(F.array_except(v, F.array(F.lit("the"), F.lit("of")))) == 0).alias("all_allowed"))


@query("w05_prompt_budget", """WITH RECURSIVE d AS (SELECT source, length(text) AS len, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents), t AS (SELECT source, n, len FROM d WHERE n <= 6), c AS (SELECT source, count(*) AS k FROM t GROUP BY source),
  r AS (SELECT c.source, k, 0 AS n, 3000 AS remaining, 0 AS take FROM c UNION ALL SELECT r.source, r.k, r.n + 1, r.remaining - CAST(least(t.len, floor(r.remaining / (r.k - r.n))) AS INTEGER), CAST(least(t.len, floor(r.remaining / (r.k - r.n))) AS INTEGER) FROM r JOIN t ON t.source = r.source AND t.n = r.n + 1)
  SELECT source, n AS place, take FROM r WHERE n > 0""")
def w05(spark, sf_dir):
    """w05, r04: a fair share of 3000 characters for each of the first six texts of a source."""
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.length("text").alias("len"))
    six = d.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("n <= 6").groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "len"))), lambda x: x["len"]).alias("lens"))
    return six.select("source", F.posexplode(X.evidence_allowances(F.col("lens"), 3000)).alias("n", "take")).select("source", (F.col("n") + 1).alias("place"), "take")


@query("f15_filters", sql("""SELECT id, status IN ('active', 'conflicted') AS searchable, memory_type = 'semantic' AND status = 'active' AND created_at < TIMESTAMP '2024-01-20 00:00:00' AS listed, id % 7 = 3 OR kind = 'kind-2' AS of_goal, kind <> 'kind-1' AND source <> 'src4' AS evidence,
  source IN ('src1', 'src2') AS allowed, coalesce(nullif(source, ''), 'legacy/unknown') AS origin FROM memory""", "memory"))
def f15(spark, sf_dir):
    """f01, f02, f09, f10, f11, f16, f19: predicates on memories, without their vectors."""
    c = F.col
    tags = F.array(F.concat(F.lit("goal:"), (c("id") % 7).cast("string")))
    return views.memory(spark, sf_dir).select(
        "id", X.searchable(c("status")).alias("searchable"), ((c("memory_type") == "semantic") & (c("status") == "active") & (c("created_at") < F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))).alias("listed"),
        (F.array_contains(tags, "goal:3") | (c("kind") == "kind-2")).alias("of_goal"), (~c("kind").isin("kind-1") & ~c("source").isin("src4")).alias("evidence"), c("source").isin("src1", "src2").alias("allowed"), F.coalesce(F.nullif("source", F.lit("")), F.lit("legacy/unknown")).alias("origin"),
    )


@query("f03_article_match", sql("""SELECT id FROM kdoc WHERE contains(lower(title || ' ' || text), 'the') AND contains(lower(title || ' ' || text), 'an') AND auto_reply = true AND lower(language) = 'en' AND contains(lower(source), 'src')""", "kdoc"))
def f03(spark, sf_dir):
    """f03, f04, f20, l05: all terms within the searched text, a three-valued flag, language without regard to case; the keys that match."""
    blob = F.lower(F.concat_ws(" ", "title", "text"))
    rows = views.kdoc(spark, sf_dir).where((F.col("auto_reply") == F.lit(True)) & (F.lower("language") == "en") & F.lower("source").contains("src"))
    for term in "The  AN ".lower().split():
        rows = rows.where(blob.contains(term))
    return rows.select("id")
