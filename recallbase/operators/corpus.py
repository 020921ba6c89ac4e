"""The article corpus and its vectors: checked upserts and deletes, what an index can reuse, what it rests on."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallbase.functions import text as T
from recallbase.operators.rules import decide


def evidence_signature(evidence: DataFrame, version: str) -> DataFrame:
    """draft_id, signature of drafts by the ids that they rest on (draft_id, memory_id, source_id, corroborating array of ids): the order of the rows doesn't matter, repeats do; null ids count as empty."""
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = F.concat(F.array(s("memory_id"), s("source_id")), F.transform(F.filter(F.coalesce("corroborating", F.array().cast("array<string>")), lambda x: x.isNotNull()), lambda x: x.cast("string")))
    g = evidence.groupBy("draft_id").agg(F.array_sort(F.flatten(F.collect_list(own))).alias("ids"))
    digest = F.sha2(F.array_join(F.concat(F.array(F.lit(version)), "ids"), "\0"), 256)
    return g.select("draft_id", F.concat(F.lit(version + ":"), F.substring(digest, 1, 24)).alias("signature"))


def index_fingerprint(settings: Mapping[str, object], sources: Sequence[str], mapping: DataFrame) -> DataFrame:
    """fingerprint (one row) of what an index rests on: settings, allowed sources and the category mapping (normalized, ids), each in order. Another one makes a stored index useless."""
    told = json.dumps({"settings": dict(sorted(settings.items())), "sources": sorted(sources)}, sort_keys=True, ensure_ascii=False)
    rows = mapping.agg(F.array_sort(F.collect_list(F.struct("normalized", "ids"))).alias("m"))  # a mapping is a small table of settings
    return rows.select(F.sha2(F.concat(F.lit(told), F.to_json("m")), 256).alias("fingerprint"))


def article_state(new: DataFrame, old: DataFrame, sources: Sequence[str]) -> DataFrame:
    """id and state of articles to be stored: `stored`, or why not. new: (id, title, text, source, language, communication_style, min_score); old: (id, kind `managed`, `static` or `external`, hash), hash being that of `article_hash`.

    A stored one is `created`, `updated` or `unchanged`; only the first two need new vectors. Of new rows with one id the last in order of their hash counts.
    """
    c, t = F.col, (lambda name: F.trim(F.coalesce(name, F.lit(""))))
    rows = new.select(t("id").alias("id"), t("title").alias("title"), t("text").alias("text"), F.lower(t("source")).alias("source"), t("language").alias("language"), F.lower(t("communication_style")).alias("communication_style"), F.coalesce("min_score", F.lit(0.0)).alias("min_score"))
    rows = rows.withColumn("hash", article_hash()).groupBy("id").agg(F.max_by(F.struct(*[x for x in rows.columns if x != "id"], "hash"), "hash").alias("r")).select("id", "r.*")
    j = rows.join(old.select("id", "kind", c("hash").alias("_old")), "id", "left")
    allowed = c("source").isin(*[x.strip().lower() for x in sources])
    state = decide([
        ("id_or_title_missing", (c("id") != "") & (c("title") != "")), ("id_not_safe", c("id").rlike(r"^[A-Za-z0-9._-]+$")), ("source_missing", c("source") != ""), ("source_not_allowed", allowed), ("language_or_style_missing", (c("language") != "") & (c("communication_style") != "")),
        ("min_score_out_of_range", c("min_score").between(0, 1)), ("externally_synchronised", c("kind").isNull() | (c("kind") != "external")), ("static_is_read_only", c("kind").isNull() | (c("kind") == "managed")),
    ], "stored")
    what = F.when(c("_old").isNull(), "created").when(c("_old") == c("hash"), "unchanged").otherwise("updated")
    return j.select("id", F.when(state == "stored", what).otherwise(state).alias("state"), "hash")


def article_hash() -> Column:
    """Of what the vectors of an article depend on."""
    return F.sha2(F.concat_ws("\x1f", "title", "text"), 256)


def delete_articles(articles: DataFrame, chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Articles (id, kind) and chunks (id, ..) without the managed ones of ids, and what became of each id: `deleted`, `read_only` or `not_found`. A static article of the same id that a managed one hid isn't brought back."""
    asked = ids.select("id").distinct()
    state = asked.join(articles.select("id", "kind"), "id", "left").select("id", F.when(F.col("kind").isNull(), "not_found").when(F.col("kind") == "managed", "deleted").otherwise("read_only").alias("state"))
    gone = state.where("state = 'deleted'").select("id")
    return articles.join(gone, "id", "left_anti"), chunks.join(gone, "id", "left_anti"), state


def index_plan(docs: DataFrame, cache: DataFrame, words: int = 160, over: int = 30) -> DataFrame:
    """id, hash, chunks, action of every article (id, title, text): `reuse` where the cache (id, hash, chunk_vectors, the number of vectors it holds) has as many vectors for the same content, else `embed`; `drop` for cached articles that are gone."""
    now = docs.select("id", article_hash().alias("hash"), F.size(T.chunk_words(F.col("text"), words, over)).alias("chunks"))
    j = now.join(cache.select("id", F.col("hash").alias("_h"), "chunk_vectors"), "id", "full")
    same = (F.col("hash") == F.col("_h")) & (F.col("chunks") == F.col("chunk_vectors"))
    return j.select("id", "hash", "chunks", F.when(F.col("hash").isNull(), "drop").when(same, "reuse").otherwise("embed").alias("action"))
