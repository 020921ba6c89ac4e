"""Vector search, text relevance and ranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recallbase.functions import exprs as X
from recallbase.functions import text as T
from recallbase.operators import vectors as V
from recallbase.operators.retrieval import contained_words, coverage, phrases, similar_words, title_similarities
from recallbase.operators.shared import in_blocks
from recallbase.plans import views
from recallbase.plans.registry import query
from recallbase.plans.views import sql

_SEARCH = """scored AS (SELECT q.id AS query_id, m.id, m.source, list_dot_product(q.vector, m.vector) / (sqrt(list_dot_product(q.vector, q.vector)) * sqrt(list_dot_product(m.vector, m.vector))) AS similarity,
    0.75e0 + 0.25e0 * m.salience AS salience_factor, CASE m.memory_type WHEN 'episodic' THEN 1e0 WHEN 'semantic' THEN 1.15e0 WHEN 'procedural' THEN 1.20e0 ELSE 0.85e0 END AS type_weight,
    0.85e0 + 0.15e0 * CASE WHEN m.confidence > 0 THEN m.confidence ELSE 1e0 END AS confidence_factor
    FROM memory q JOIN memory m ON m.id <> q.id WHERE q.id % 50 = 0 AND m.status IN ('active', 'conflicted')),
  ranked AS (SELECT *, similarity * salience_factor * type_weight * confidence_factor AS score FROM scored WHERE similarity >= 0.05e0)"""


def _queries(memory):
    return memory.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")


@query("v03_vector_search", sql(_SEARCH + """, top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM ranked)
  SELECT query_id, id, similarity, salience_factor, type_weight, confidence_factor, score, rank, 'scan' AS candidate_source FROM top WHERE rank <= 8""", "memory"))
def v03(spark, sf_dir):
    m = views.memory(spark, sf_dir)
    return V.search(_queries(m), m, k=8, least=0.05)


@query("v05_source_scoped_search", sql(_SEARCH + """, top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM ranked WHERE source IN ('src0', 'src3', 'src5'))
  SELECT query_id, id, similarity, score, rank FROM top WHERE rank <= 5""", "memory"))
def v05(spark, sf_dir):
    m = views.memory(spark, sf_dir)
    return V.search(_queries(m), m, k=5, least=0.05, allowed=F.col("source").isin("src0", "src3", "src5")).select("query_id", "id", "similarity", "score", "rank")


@query("v07_outcome_search", sql(_SEARCH + """, top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM ranked WHERE similarity >= 0.15e0 AND source IN ('src1', 'src2'))
  SELECT query_id, id, similarity, score, rank FROM top WHERE rank <= 8""", "memory"))
def v07(spark, sf_dir):
    m = views.memory(spark, sf_dir)
    return V.search(_queries(m), m, k=8, least=0.15, allowed=F.col("source").isin("src1", "src2")).select("query_id", "id", "similarity", "score", "rank")


@query("v08_federated_search", sql(_SEARCH + """, sharded AS (SELECT query_id, id, similarity, score * CASE WHEN id % 2 = 0 THEN 1e0 ELSE 0.9e0 END AS score, CASE WHEN id % 2 = 0 THEN 'local' ELSE 'remote' END AS shard,
      row_number() OVER (PARTITION BY query_id, id % 2 ORDER BY score DESC, id) AS own FROM ranked),
  top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, shard, id) AS INTEGER) AS rank FROM sharded WHERE own <= 8)
  SELECT query_id, id, similarity, score, shard, rank FROM top WHERE rank <= 8""", "memory"))
def v08(spark, sf_dir):
    m = views.memory(spark, sf_dir)
    part = lambda r: V.search(_queries(m), m, k=8, least=0.05, allowed=F.col("id") % 2 == r)
    return V.federated([("local", 1.0, part(0)), ("remote", 0.9, part(1))], 8)


_KNN = """pairs AS (SELECT q.id AS query_id, m.id, round(list_dot_product(q.vector, m.vector) / (sqrt(list_dot_product(q.vector, q.vector)) * sqrt(list_dot_product(m.vector, m.vector))), 9) AS s, m.memory_type, m.kind, q.memory_type AS qt, q.kind AS qk, m.status
    FROM memory q JOIN memory m ON m.id <> q.id WHERE q.id % 50 = 0)"""


@query("v20_relink_candidates", sql(_KNN + """, top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS INTEGER) AS rank FROM pairs WHERE s >= 0.1e0)
  SELECT query_id, id, round(s, 6) AS similarity, rank FROM top WHERE rank <= 12""", "memory"))
def v20(spark, sf_dir):
    m = views.memory(spark, sf_dir)
    q = m.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    return V.neighbours(q, m, 12, 0.1).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query("v19_duplicate_lookup", sql(_KNN + """, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM pairs WHERE s >= 0.1e0 AND status = 'active' AND memory_type = qt AND kind = qk)
  SELECT query_id, id, round(s, 6) AS similarity FROM top WHERE rank = 1""", "memory"))
def v19(spark, sf_dir):
    m = views.memory(spark, sf_dir).withColumn("class", F.concat_ws("|", "memory_type", "kind"))
    q = m.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector", "class")
    return V.neighbours(q, m.where("status = 'active'"), 1, 0.1, within="class").select("query_id", "id", F.round("similarity", 6).alias("similarity"))


@query("v22_centroid", """SELECT label, pos, round(avg(x), 6) AS x FROM (SELECT label, unnest(generate_series(0, len(embedding) - 1)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label, pos""")
def v22(spark, sf_dir):
    c = V.centroids(spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumnRenamed("embedding", "vector"), "label")
    return c.select("label", F.posexplode("vector").alias("pos", "x")).select("label", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query("v18_l2_normalize", """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 9) AS norm2, len(embedding) AS dim,
  round(CAST(embedding[1] AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 9) AS first FROM embeddings""")
def v18(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", F.round(X.dot(F.col("embedding"), F.col("embedding")), 9).alias("norm2"), F.size("embedding").cast("long").alias("dim"), F.round(F.element_at(X.l2_normalize(F.col("embedding")), 1), 9).alias("first"))


@query("v17_nearest_centroid", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), p AS (SELECT label, unnest(generate_series(1, len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
  c AS (SELECT label AS i, list(x ORDER BY pos) AS y FROM (SELECT label, pos, avg(x) AS x FROM p GROUP BY label, pos) GROUP BY label),
  d AS (SELECT vec_id, i, list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c)
  SELECT vec_id, CAST(arg_min(i, d) AS INTEGER) AS cell FROM d GROUP BY vec_id""")
def v17(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    centers = V.centroids(e.withColumnRenamed("embedding", "vector"), "label").orderBy("label").collect()  # a row per class
    place = V.nearest_centroid(F.col("embedding"), [list(r.vector) for r in centers])
    return e.select("vec_id", F.element_at(F.array(*[F.lit(r.label) for r in centers]), place + 1).cast("int").alias("cell"))


@query("v24_index_build_policy", sql("""SELECT memory_type, count(*) AS records, count(*) >= 20 AND (sum(CASE WHEN status = 'archived' THEN 1 ELSE 0 END) = 0 OR max(access_count) > 10) AS build FROM memory GROUP BY memory_type""", "memory"))
def v24(spark, sf_dir):
    rows = views.memory(spark, sf_dir).groupBy("memory_type").agg(F.count("*").alias("records"), F.max((F.col("status") == "archived").cast("int")).alias("built"), F.max("access_count").alias("seen"))
    return rows.select("memory_type", "records", V.index_needs_build(F.col("records"), 20, F.col("built") == 1, F.lit(24.0), 12.0, F.col("seen") > 10).alias("build"))


_TERMS = ("the", "token")
_QUERY = "the token"
_FIELDS = ((28, "CAST(id AS VARCHAR)"), (24, "lower(title)"), (7, "lower(text)"), (2, "lower(source)"))


def _relevance_sql() -> str:
    parts = []
    for i, (w, f) in enumerate(_FIELDS):
        parts.append(f"CASE WHEN {f} = '{_QUERY}' THEN {w * 8} ELSE 0 END + CASE WHEN contains({f}, '{_QUERY}') THEN {w * 3} ELSE 0 END")
        parts += [f"CASE WHEN {f} = '{t}' THEN {w * 4} WHEN contains({f}, '{t}') THEN {w} ELSE 0 END" for t in _TERMS]
        if i == 1:
            parts.append(f"CASE WHEN starts_with({f}, '{_QUERY}') THEN 40 ELSE 0 END")
    return " + ".join(parts)


def relevance(fields, phrase: str):
    """Relevance of weighted fields to a phrase: 8 weights for equality, 3 for containment, 4 or 1 per term; 40 for a title that begins with it."""
    low, total = phrase.lower().strip(), F.lit(0)
    for i, (weight, column) in enumerate(fields):
        value = F.lower(column.cast("string"))
        total = total + F.when(value == low, weight * 8).otherwise(0) + F.when(value.contains(low), weight * 3).otherwise(0)
        for term in low.split():
            total = total + F.when(value == term, weight * 4).when(value.contains(term), weight).otherwise(0)
        if i == 1:
            total = total + F.when(value.startswith(low), 40).otherwise(0)
    return total


@query("l03_kb_search_page", sql(f"""hits AS (SELECT id, title, {_relevance_sql()} AS score FROM kdoc WHERE contains(lower(text), 'the') AND contains(lower(text), 'token'))
  SELECT id, title, CAST(score AS INTEGER) AS score FROM hits ORDER BY score DESC, lower(title), id LIMIT 20""", "kdoc"))
def l03(spark, sf_dir):
    d = views.kdoc(spark, sf_dir)
    for term in _TERMS:
        d = d.where(F.lower("text").contains(term))
    fields = [(28, F.col("id")), (24, F.col("title")), (7, F.col("text")), (2, F.col("source"))]
    return d.select("id", "title", relevance(fields, _QUERY).alias("score")).orderBy(F.desc("score"), F.lower("title"), "id").limit(20)


@query("x13_relevance_score", sql(f"SELECT id, CAST({_relevance_sql()} AS INTEGER) AS score FROM kdoc", "kdoc"))
def x13(spark, sf_dir):
    return views.kdoc(spark, sf_dir).select("id", relevance([(28, F.col("id")), (24, F.col("title")), (7, F.col("text")), (2, F.col("source"))], _QUERY).alias("score"))


_TOK = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{Nd}}]+'), lambda t: length(t) >= 3 AND NOT list_contains([{1}], t))"


def _tok(text: str) -> str:
    return _TOK.format(text, ", ".join(f"'{w}'" for w in T.STOPWORDS))


@query("c01_token_list", f"SELECT doc_id, len(t) AS n, len(list_distinct(t)) AS n_distinct, sha256(array_to_string(t, ' ')) AS joined FROM (SELECT doc_id, {_tok('text')} AS t FROM documents)")
def c01(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.token_list(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.sha2(F.array_join("t", " "), 256).alias("joined"))


@query("x10_token_f1", f"""WITH b AS (SELECT item_id, list_distinct({_tok('text')}) AS q FROM benchmark WHERE item_id % 50 = 0), d AS (SELECT doc_id, list_distinct({_tok('text')}) AS t FROM documents),
  p AS (SELECT item_id, doc_id, CAST(len(list_intersect(q, t)) AS DOUBLE) AS c, len(q) AS nq, len(t) AS nt FROM b, d)
  SELECT item_id, doc_id, round(2 * (c / nq) * (c / nt) / (c / nq + c / nt), 9) AS f1, round(c / nq, 9) AS overlap FROM p WHERE c / nq >= 0.5e0""")
def x10(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("item_id % 50 = 0").select("item_id", T.tokens(F.col("text")).alias("q"))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.tokens(F.col("text")).alias("t"))
    p = in_blocks(b, "item_id", d.join)  # the stated queries, against all rows
    return p.select("item_id", "doc_id", F.round(T.token_f1(F.col("q"), F.col("t")), 9).alias("f1"), F.round(T.overlap(F.col("q"), F.col("t")), 9).alias("overlap")).where("overlap >= 0.5")


@query("x17_candidate_selection", f"""WITH b AS (SELECT item_id, list_distinct({_tok('text')}) AS q FROM benchmark WHERE item_id % 50 = 0), d AS (SELECT doc_id, list_distinct({_tok('text')}) AS t FROM documents),
  s AS (SELECT item_id, doc_id, round(CAST(len(list_intersect(q, t)) AS DOUBLE) / len(q), 9) AS score FROM b, d),
  r AS (SELECT *, max(score) OVER (PARTITION BY item_id) AS best, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s)
  SELECT item_id, doc_id, score, rank, CASE WHEN best >= 0.3e0 AND score >= greatest(0.3e0, best - 0.4e0) AND rank <= 5 THEN 'sent_to_ai' WHEN score < 0.3e0 THEN 'below_retrieval_floor'
    WHEN score < greatest(0.3e0, best - 0.4e0) THEN 'outside_candidate_gap' WHEN rank > 5 THEN 'max_candidates_reached' ELSE 'not_selected' END AS reason FROM r WHERE rank <= 12""")
def x17(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("item_id % 50 = 0").select("item_id", T.tokens(F.col("text")).alias("q"))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.tokens(F.col("text")).alias("t"))
    hits = in_blocks(b, "item_id", d.join).select("item_id", "doc_id", F.round(T.overlap(F.col("q"), F.col("t")), 9).alias("score"))
    return select_candidates(hits, "item_id", most=5, floor=0.3, gap=0.4, audit=12)


def select_candidates(hits, key: str, most: int, floor: float, gap: float, audit: int):
    """Ranks hits (key, doc_id, score) and says why each was sent on or not: best under the floor sends none, then a gap from the best, then a number."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "doc_id")
    first = Window.partitionBy(key)
    r = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= audit).withColumn("best", F.max("score").over(first))
    cutoff = F.greatest(F.lit(floor), F.col("best") - gap)
    sent = (F.col("best") >= floor) & (F.col("score") >= cutoff) & (F.col("rank") <= most)
    why = F.when(sent, "sent_to_ai").when(F.col("score") < floor, "below_retrieval_floor").when(F.col("score") < cutoff, "outside_candidate_gap").when(F.col("rank") > most, "max_candidates_reached").otherwise("not_selected")
    return r.select(key, "doc_id", "score", "rank", why.alias("reason"))


@query("x18_source_authority", sql(r"""h AS (SELECT id, uri, trust, lower(regexp_extract(uri, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM source)
  SELECT id, host, CASE WHEN regexp_matches(host, '(^|\.)(ubuntu\.com|learn\.microsoft\.com|cloud\.google\.com)$') THEN 'authoritative' WHEN host IN ('github.com', 'reddit.com', 'stackoverflow.com') THEN 'community'
    WHEN regexp_matches(host, '^(docs|support|kb|knowledgebase)\.') THEN 'documentation-unverified' WHEN trust >= 0.9e0 THEN 'trusted-web' ELSE 'supplemental-web' END AS authority FROM h""", "source"))
def x18(spark, sf_dir):
    s = views.source(spark, sf_dir)
    return s.select("id", F.lower(F.try_parse_url("uri", F.lit("HOST"))).alias("host"), T.authority(F.col("uri"), F.col("trust"))["label"].alias("authority"))


@query("c20_origin_key", sql(r"""h AS (SELECT id, string_split(lower(regexp_extract(uri, '^[a-z]+://([^/:?#]+)', 1)), '.') AS p FROM source)
  SELECT id, CASE WHEN len(p) <= 2 THEN array_to_string(p, '.') WHEN length(p[-1]) = 2 AND p[-2] IN ('co', 'com', 'org', 'net', 'gov', 'ac') THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS origin FROM h""", "source"))
def c20(spark, sf_dir):
    return views.source(spark, sf_dir).select("id", T.origin_key(F.col("uri")).alias("origin"))


@query("x20_memory_utility", sql("""SELECT id, round(0.30e0 * exp(-greatest(CAST(date_diff('microsecond', created_at, TIMESTAMP '2024-02-15 00:00:00') AS DOUBLE) / 86400000000e0, 0e0) / 30)
    + 0.20e0 * least(1e0, ln(1 + CAST(access_count AS DOUBLE)) / 4) + 0.20e0 * least(greatest(salience / 2, 0e0), 1e0) + 0.20e0 * least(greatest(confidence, 0e0), 1e0) + 0.10e0 * least(greatest((reward + 1) / 2, 0e0), 1e0), 9) AS utility,
    round(0.55e0 * confidence + 0.25e0 * least(greatest((reward + 1) / 2, 0e0), 1e0) + 0.20e0 * least(greatest(salience / 2, 0e0), 1e0), 9) AS knowledge,
    round(salience + 0.5e0 * confidence + 0.01e0 * access_count + CASE WHEN status = 'active' THEN 0.5e0 ELSE 0e0 END, 9) AS priority FROM memory""", "memory"))
def x20(spark, sf_dir):
    c = F.col
    return views.memory(spark, sf_dir).select(
        "id", F.round(X.memory_utility(X.age_days(c("created_at"), "2024-02-15 00:00:00"), c("access_count"), c("salience"), c("confidence"), c("reward")), 9).alias("utility"),
        F.round(X.knowledge_score(c("confidence"), c("reward"), c("salience")), 9).alias("knowledge"), F.round(X.display_priority(c("salience"), c("confidence"), c("access_count"), c("status") == "active", F.lit(False), F.lit(False)), 9).alias("priority"),
    )


@query("x15_category_shortlist", sql("""w AS (SELECT ticket_id, unnest(list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{Nd}]+'), lambda t: length(t) >= 3)) AS word FROM ticket),
  c AS (SELECT min(p_partkey) AS category_id, lower(p_name) AS name FROM part GROUP BY lower(p_name)),
  s AS (SELECT ticket_id, category_id, count(*) AS score FROM w JOIN c ON contains(c.name, w.word) GROUP BY ticket_id, category_id),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY ticket_id ORDER BY score DESC, category_id) AS INTEGER) AS rank FROM s)
  SELECT ticket_id, category_id, score, rank FROM r WHERE rank <= 5""", "ticket"))
def x15(spark, sf_dir):
    words = views.ticket(spark, sf_dir).select("ticket_id", F.explode(F.filter(T.research_words(F.col("content")), lambda t: F.length(t) >= 3)).alias("word"))
    cats = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.lower("p_name").alias("name")).agg(F.min("p_partkey").alias("category_id"))
    per = words.groupBy("ticket_id", "word").agg(F.count("*").alias("n"))
    met = contained_words(per.select("word").distinct(), cats.select("name")).join(cats, "name")
    score = per.join(met, "word").groupBy("ticket_id", "category_id").agg(F.sum("n").alias("score"))
    w = Window.partitionBy("ticket_id").orderBy(F.desc("score"), "category_id")
    return score.withColumn("rank", F.row_number().over(w)).where("rank <= 5")


def _stem_sql(word: str) -> str:
    return "CASE " + " ".join(f"WHEN ends_with({word}, '{x}') AND strlen({word}) - {len(x)} >= 5 THEN substring({word}, 1, length({word}) - {len(x)})" for x in T.SUFFIXES) + f" ELSE {word} END"


#: SQL for the similarity of the tokens a and b with stems sa and sb, as T.token_similarity has it.
_SIMILAR = """CASE WHEN a = b THEN 1e0 WHEN strlen(a) < 4 OR strlen(b) < 4 THEN 0e0
  WHEN least(strlen(a), strlen(b)) >= 5 AND CASE WHEN strlen(a) <= strlen(b) THEN contains(b, a) ELSE contains(a, b) END THEN least(1e0, 0.75e0 + 0.25e0 * (CAST(least(strlen(a), strlen(b)) AS DOUBLE) / greatest(strlen(a), strlen(b))))
  WHEN sa = sb AND strlen(sa) >= 5 THEN 0.95e0
  WHEN least(strlen(sa), strlen(sb)) >= 5 AND CASE WHEN strlen(sa) <= strlen(sb) THEN contains(sb, sa) ELSE contains(sa, sb) END THEN 0.90e0
  WHEN common >= 5 AND CAST(common AS DOUBLE) / least(strlen(a), strlen(b)) >= 0.70e0 THEN least(1e0, CAST(common AS DOUBLE) / greatest(strlen(a), strlen(b))) ELSE 0e0 END"""
_COMMON = "len(list_filter(range(1, least(strlen(a), strlen(b)) + 1), lambda i: substring(hex(encode(a)), 1, 2 * i) = substring(hex(encode(b)), 1, 2 * i)))"


def _pairs_sql(terms: str, words: str) -> str:
    """CTEs up to `sim` (a, b, s): similarities above 0 of the words of two tables of one column w each."""
    return f"""ta AS (SELECT w AS a, {_stem_sql('w')} AS sa FROM (SELECT DISTINCT w FROM {terms})), tb AS (SELECT w AS b, {_stem_sql('w')} AS sb FROM (SELECT DISTINCT w FROM {words})),
  near AS MATERIALIZED (SELECT *, {_COMMON} AS common FROM ta JOIN tb ON substring(a, 1, 3) = substring(b, 1, 3) OR contains(a, substring(b, 1, 3)) OR contains(b, substring(a, 1, 3))),
  sim AS MATERIALIZED (SELECT a, b, s FROM (SELECT a, b, {_SIMILAR} AS s FROM near) WHERE s > 0)"""


_ASKED = f"asked AS (SELECT item_id AS query_id, text, {_tok('text')} AS q FROM benchmark WHERE item_id % 50 = 0)"
_TITLED = f"titled AS (SELECT doc_id AS id, title, {_tok('title')} AS t FROM (SELECT doc_id, substring(text, 1, 60) AS title FROM documents))"


def _asked(spark, sf_dir):
    """The stated queries, every fiftieth benchmark item."""
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "text")


def _titled(spark, sf_dir):
    """Documents with their first sixty characters as the title that the table lacks."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.substring("text", 1, 60).alias("title"))


@query("x09_token_similarity", f"""WITH {_ASKED}, d AS (SELECT {_tok('text')} AS t FROM documents), qw AS (SELECT unnest(q) AS w FROM asked), dw AS (SELECT unnest(t) AS w FROM d),
  {_pairs_sql("qw", "dw")} SELECT a AS term, b AS token, round(s, 9) AS similarity FROM sim WHERE length(a) >= 3 AND length(b) >= 3""")
def x09(spark, sf_dir):
    """All similar pairs of a word of a stated query and a word of the documents."""
    words = lambda rows, name: rows.select(F.explode(T.tokens(F.col("text"))).alias(name)).where(F.length(name) >= 3).distinct()
    found = similar_words(words(_asked(spark, sf_dir), "term"), words(spark.read.parquet(f"{sf_dir}/documents.parquet"), "token"))
    return found.select("term", "token", F.round("similarity", 9).alias("similarity"))


@query("x08_token_coverage", f"""WITH {_ASKED}, {_TITLED}, qw AS (SELECT query_id, unnest(q) AS w FROM asked), tw AS (SELECT DISTINCT id, unnest(t) AS w FROM titled),
  {_pairs_sql("qw", "tw")}, n AS (SELECT query_id, len(q) AS n FROM asked), k AS (SELECT query_id, w, count(*) AS times FROM qw GROUP BY ALL),
  best AS (SELECT k.query_id, k.times, tw.id, k.w, max(s) AS best FROM k JOIN sim ON sim.a = k.w JOIN tw ON tw.w = sim.b GROUP BY ALL)
  SELECT query_id, id, round(least(1e0, sum(best * times) / any_value(n)), 9) AS value FROM best JOIN n USING (query_id) GROUP BY query_id, id""")
def x08(spark, sf_dir):
    """How far titles cover the words of stated queries, through the similar words that both have."""
    q = _asked(spark, sf_dir).select("query_id", T.token_list(F.col("text")).alias("terms"))
    t = _titled(spark, sf_dir).select("id", F.explode(T.tokens(F.col("title"))).alias("token"))
    matches = similar_words(q.select(F.explode("terms").alias("term")).distinct(), t.select("token").distinct())
    return coverage(q, t, matches, "id").select("query_id", "id", F.round("value", 9).alias("value"))


@query("x07_phrase_coverage", f"""WITH {_ASKED}, ph AS (SELECT p_brand AS key, p_name AS phrase, {_tok('p_name')} AS t FROM part WHERE trim(p_name) <> '' UNION ALL SELECT 'label ' || item_id % 3, substring(text, 5, 40), {_tok('substring(text, 5, 40)')} FROM benchmark),
  u AS (SELECT DISTINCT phrase, t FROM ph), qw AS (SELECT query_id, unnest(q) AS w FROM asked), pw AS (SELECT phrase, unnest(t) AS w FROM u),
  {_pairs_sql("pw", "qw")}, best AS (SELECT query_id, phrase, i, coalesce(max(s), 0) AS best FROM asked, (SELECT phrase, unnest(t) AS w, unnest(range(len(t))) AS i FROM u) x LEFT JOIN sim ON sim.a = x.w AND list_contains(asked.q, sim.b) GROUP BY ALL),
  cover AS (SELECT query_id, phrase, least(1e0, sum(best) / count(*)) AS value FROM best GROUP BY ALL),
  v AS (SELECT query_id, phrase, CASE WHEN len(q) = 0 OR len(t) = 0 THEN 0e0 WHEN contains(array_to_string(q, ' '), array_to_string(t, ' ')) THEN 1e0 ELSE coalesce(value, 0e0) END AS value FROM asked CROSS JOIN u LEFT JOIN cover USING (query_id, phrase))
  SELECT query_id, key, round(max(value), 9) AS value FROM v JOIN ph USING (phrase) WHERE value > 0 GROUP BY query_id, key""")
def x07(spark, sf_dir):
    """x05, x06: the best coverage of a key's phrases (keywords, or names and hints of a category) by each stated query."""
    b, p = spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = p.select(F.col("p_brand").alias("key"), F.col("p_name").alias("phrase")).unionByName(b.select(F.concat(F.lit("label "), (F.col("item_id") % 3).cast("string")).alias("key"), F.substring("text", 5, 40).alias("phrase")))
    return phrases(_asked(spark, sf_dir), rows, "key").select("query_id", "key", F.round("value", 9).alias("value"))


@query("x03_title_similarity", f"""WITH {_ASKED}, {_TITLED}, qw AS (SELECT query_id, unnest(q) AS w FROM asked), tw AS (SELECT DISTINCT id, unnest(t) AS w FROM titled),
  {_pairs_sql("qw", "tw")}, k AS (SELECT query_id, w, count(*) AS times FROM qw GROUP BY ALL),
  best AS (SELECT k.query_id, k.times, tw.id, k.w, max(s) AS best FROM k JOIN sim ON sim.a = k.w JOIN tw ON tw.w = sim.b GROUP BY ALL), cover AS (SELECT query_id, id, sum(best * times) AS total FROM best GROUP BY ALL),
  v AS (SELECT query_id, id, CASE WHEN trim(text) = '' OR trim(title) = '' THEN 0e0 WHEN array_to_string(q, ' ') = array_to_string(t, ' ') OR contains(array_to_string(t, ' '), array_to_string(q, ' ')) OR contains(array_to_string(q, ' '), array_to_string(t, ' ')) THEN 1e0
    ELSE greatest(CASE WHEN len(q) > 0 AND len(t) > 0 THEN least(1e0, coalesce(total, 0) / len(q)) ELSE 0e0 END,
      coalesce(2e0 * len(list_intersect(list_distinct(q), list_distinct(t))) / nullif(len(list_distinct(q)) + len(list_distinct(t)), 0), 0e0)) END AS value FROM asked CROSS JOIN titled LEFT JOIN cover USING (query_id, id))
  SELECT query_id, id, round(value, 9) AS value FROM v WHERE round(value, 9) >= 0.2e0""")
def x03(spark, sf_dir):
    """Titles like the stated queries, each against all."""
    met = title_similarities(_asked(spark, sf_dir), _titled(spark, sf_dir))
    return met.select("query_id", "id", F.round("value", 9).alias("value")).where("value >= 0.2")
