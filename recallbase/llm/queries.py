"""The operators over their whole tables, with production parameters, in the shapes that were agreed for them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallbase.llm import decontaminate, fixity, hnsw, langid, negatives, packing, quality, secrets, sharding, simhash, spelling, tokenfile, toxicity

#: Pages whose replica op7 damages, so that the audit has something to find: every DAMAGED-th id.
DAMAGED = 97


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document and benchmark item it holds a copy of, exact or edited."""
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.tokenize_to_files(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predict(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, size=4096)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_read(spark, sf_dir, "documents"), shards=16)


def op7_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of a replica audited against another, in which every DAMAGED-th page has lost its first character."""
    pages = _read(spark, sf_dir, "pages")
    hit = F.col("page_id") % DAMAGED == 0
    cut_short = pages.withColumn("html", F.when(hit, F.substring("html", 2, 1 << 30)).otherwise(F.col("html")))
    return fixity.manifest(fixity.records(pages), fixity.records(cut_short))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(_read(spark, sf_dir, "documents"))


def op9_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(_read(spark, sf_dir, "embeddings"), every=20, k=20)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row has a wrong label, so that there are hard negatives of the same cluster."""
    rows = _read(spark, sf_dir, "embeddings")
    return negatives.mine(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_read(spark, sf_dir, "documents"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontaminate, op2_langid, op3_token_files, op4_toxicity, op5_packing, op6_sharding, op7_fixity, op8_secrets, op9_hnsw, op10_simhash, op11_negatives, op12_spelling, op13_quality)
}

ORACLES: dict[str, str] = {
    "op7_fixity": f"""
      WITH raw AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
      rec AS (
        SELECT page_id, CAST(floor(page_id / 1024) AS BIGINT) AS file,
               'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:' AS head,
               '>' || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' AS rest,
               chr(13) || chr(10) || chr(13) || chr(10) AS gap, url, html,
               CASE WHEN page_id % {DAMAGED} = 0 THEN substring(html, 2) ELSE html END AS other FROM raw),
      named AS (
        SELECT *, regexp_replace(md5(url || chr(10) || html), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') AS id_a,
               regexp_replace(md5(url || chr(10) || other), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') AS id_b FROM rec),
      whole AS (
        SELECT page_id, file, head || id_a || rest || CAST(strlen(html) AS VARCHAR) || gap || html || gap AS a, head || id_b || rest || CAST(strlen(other) AS VARCHAR) || gap || other || gap AS b FROM named),
      placed AS (
        SELECT file, page_id, row_number() OVER w - 1 AS record, CAST(sum(strlen(a)) OVER w - strlen(a) AS BIGINT) AS start,
               strlen(a) AS length, sha256(a) AS digest, sha256(b) AS other_digest,
               sum(CASE WHEN a <> b THEN 1 ELSE 0 END) OVER w AS n
        FROM whole WINDOW w AS (PARTITION BY file ORDER BY page_id))
      SELECT file, page_id, record, start, CAST(length AS BIGINT) AS length, digest, other_digest,
             CASE WHEN digest = other_digest THEN 'ok' ELSE 'changed' END AS status FROM placed""",
    "op11_negatives": """
      WITH row AS MATERIALIZED (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
        FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      scored AS MATERIALIZED (
        SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
        FROM row a JOIN row r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id AND len(r.v) = len(a.v)),
      positive AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
      SELECT anchor_id, positive_id, row_number() OVER o AS rank, vec_id AS negative_id, positive_score, score AS negative_score
      FROM positive JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
      WINDOW o AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER o <= 10""",
    # crc32 is linear: every byte adds, by exclusive or, what a table has for its value and its place from the end
    "op12_spelling": """
      WITH RECURSIVE
      bits(b, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
      one AS MATERIALIZED (SELECT b, c FROM bits WHERE k = 8),
      run AS MATERIALIZED (
        SELECT doc_id, word, count(*) AS times, CAST(doc_id AS VARCHAR) || ':' || word AS said
        FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{7,}')) AS word FROM documents)
        GROUP BY doc_id, word),
      far AS (SELECT max(strlen(said)) AS n FROM run),
      place(p, b, c) AS (SELECT 0, b, c FROM one UNION ALL SELECT p + 1, t.b, xor(o.c, t.c >> 8) FROM place t JOIN one o ON o.b = t.c & 255, far WHERE p + 1 < far.n),
      byte AS (
        SELECT said, strlen(said) - 1 - i AS p,
               xor(16 * (instr('0123456789ABCDEF', substring(hex(encode(said)), 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substring(hex(encode(said)), 2 * i + 2, 1)) - 1, CASE WHEN i < 4 THEN 255 ELSE 0 END) AS b
        FROM (SELECT said, CAST(unnest(range(strlen(said))) AS INTEGER) AS i FROM run WHERE said IS NOT NULL)),
      summed AS (SELECT said, xor(bit_xor(c), 4294967295) AS h FROM byte JOIN place USING (p, b) GROUP BY said),
      slipped AS (
        SELECT CASE WHEN h % 31 = 0 THEN substring(word, 1, CAST(h % length(word) AS INTEGER)) || substring(word, CAST(h % length(word) AS INTEGER) + 2) ELSE word END AS word, times
        FROM run LEFT JOIN summed USING (said)),
      vocabulary AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
      cuts AS MATERIALIZED (SELECT word, i, substring(word, 1, i) || substring(word, i + 2) AS rest FROM (SELECT word, CAST(unnest(range(length(word))) AS INTEGER) AS i FROM vocabulary)),
      pair AS (
        SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
        UNION SELECT word, rest FROM cuts WHERE rest IN (SELECT word FROM vocabulary)
        UNION SELECT rest, word FROM cuts WHERE rest IN (SELECT word FROM vocabulary)),
      near AS (SELECT p.word, count(*) AS n_near, arg_min(p.other, (-o.n, p.other)) AS best, max(o.n) AS best_n FROM pair p JOIN vocabulary o ON o.word = p.other GROUP BY p.word),
      named AS MATERIALIZED (
        SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n
        FROM vocabulary LEFT JOIN near USING (word)),
      steps(word, root, k) AS (SELECT word, word, 0 FROM named UNION ALL SELECT s.word, f.form, k + 1 FROM steps s JOIN named f ON f.word = s.root WHERE f.form IS NOT NULL)
      SELECT word, form, root, n, n_near, form_n FROM named JOIN (SELECT word, arg_max(root, k) AS root FROM steps GROUP BY word) USING (word)""",
    "op13_quality": """
      WITH RECURSIVE
      doc AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
      word AS MATERIALIZED (SELECT id, unnest(words) AS w, unnest(range(len(words))) AS i FROM (SELECT id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM doc)),
      sized AS (SELECT id, count(*) AS n_words, CAST(sum(length(w)) AS BIGINT) AS word_chars FROM word GROUP BY id),
      windows AS (SELECT id, i, count(*) OVER (PARTITION BY id, a, b, c) AS times FROM (SELECT id, i, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM word WINDOW o AS (PARTITION BY id ORDER BY i)) WHERE c IS NOT NULL),
      repeated AS (SELECT id, count(DISTINCT i + k) AS n_repeat_words FROM windows, (SELECT unnest([0, 1, 2]) AS k) WHERE times > 1 GROUP BY id),
      line AS (SELECT id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT id, unnest(string_split(text, chr(10))) AS l FROM doc) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY id),
      base AS MATERIALIZED (
        SELECT id, doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
               coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
               coalesce(n_words, 0) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * coalesce(n_words, 0) AS base_failed
        FROM doc LEFT JOIN sized USING (id) LEFT JOIN repeated USING (id) LEFT JOIN line USING (id)),
      rated AS MATERIALIZED (
        SELECT id, lang, source, r.rate AS rate, r.v AS v, CASE WHEN r.v < 128 THEN r.v ELSE (r.v >> (length(bin(r.v)) - 7)) << (length(bin(r.v)) - 7) END AS value
        FROM (SELECT id, lang, source, unnest([{'rate': 'word_size', 'v': 1000 * word_chars // n_words}, {'rate': 'symbols', 'v': 1000 * n_symbols // n_words}, {'rate': 'dup_lines', 'v': 1000 * n_dup_lines // n_lines}]) AS r
              FROM base WHERE NOT base_failed)),
      grouped AS (SELECT l AS level, CASE WHEN l > 0 THEN lang END AS lang, CASE WHEN l > 1 THEN source END AS source, rate, value FROM rated, (SELECT unnest([0, 1, 2]) AS l)),
      ranked AS (
        SELECT DISTINCT level, lang, source, rate, value, count(*) OVER (PARTITION BY level, lang, source, rate ORDER BY value) AS upto, count(*) OVER (PARTITION BY level, lang, source, rate) AS texts FROM grouped),
      quartile AS (
        SELECT level, lang, source, rate, max(texts) AS texts, min(value) FILTER (4 * upto >= texts) AS q1, min(value) FILTER (4 * upto >= 3 * texts) AS q3 FROM ranked GROUP BY level, lang, source, rate),
      fence AS (
        SELECT *, q1 - 3 * greatest(q3 - q1, CASE rate WHEN 'word_size' THEN 500 WHEN 'symbols' THEN 50 ELSE 200 END) AS lo,
               q3 + 3 * greatest(q3 - q1, CASE rate WHEN 'word_size' THEN 500 WHEN 'symbols' THEN 50 ELSE 200 END) AS hi FROM quartile WHERE level = 0 OR texts >= 200),
      held AS (
        SELECT r.id, r.rate, r.v, arg_max(f.lo, f.level) AS lo, arg_max(f.hi, f.level) AS hi FROM rated r JOIN fence f
          ON f.rate = r.rate AND (f.level < 1 OR f.lang IS NOT DISTINCT FROM r.lang) AND (f.level < 2 OR f.source IS NOT DISTINCT FROM r.source)
        GROUP BY r.id, r.rate, r.v),
      verdict AS (SELECT id, bool_and(v BETWEEN lo AND hi) AS inside FROM held GROUP BY id),
      seen AS (SELECT DISTINCT lang, source FROM documents),
      of_group AS (
        SELECT s.lang, s.source, f.rate, arg_max(f.lo, f.level) AS lo, arg_max(f.hi, f.level) AS hi FROM seen s JOIN fence f
          ON (f.level < 1 OR f.lang IS NOT DISTINCT FROM s.lang) AND (f.level < 2 OR f.source IS NOT DISTINCT FROM s.source) GROUP BY s.lang, s.source, f.rate),
      wide AS (
        SELECT lang, source, max(lo) FILTER (rate = 'word_size') AS lo_word_size, max(hi) FILTER (rate = 'word_size') AS hi_word_size, max(lo) FILTER (rate = 'symbols') AS lo_symbols,
               max(hi) FILTER (rate = 'symbols') AS hi_symbols, max(lo) FILTER (rate = 'dup_lines') AS lo_dup_lines, max(hi) FILTER (rate = 'dup_lines') AS hi_dup_lines FROM of_group GROUP BY lang, source)
      SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed,
             CASE WHEN NOT base_failed THEN 1000 * word_chars // n_words END AS word_size, CASE WHEN NOT base_failed THEN 1000 * n_symbols // n_words END AS symbols,
             CASE WHEN NOT base_failed THEN 1000 * n_dup_lines // n_lines END AS dup_lines, lo_word_size, hi_word_size, lo_symbols, hi_symbols, lo_dup_lines, hi_dup_lines,
             NOT base_failed AND coalesce(inside, false) AS kept
      FROM base b LEFT JOIN verdict USING (id) LEFT JOIN wide w ON w.lang IS NOT DISTINCT FROM b.lang AND w.source IS NOT DISTINCT FROM b.source""",
}
