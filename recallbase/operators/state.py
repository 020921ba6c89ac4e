"""State changes as (old, new) -> state, and the look-ups around them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallbase.functions import text as T


def insert_all(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """old and new together. A key (by default id) that is there already, or twice among the new rows, refuses the whole batch."""
    names = list(key or ("id",))
    twice = new.groupBy(*names).count().where("count > 1").select(*names)
    taken = new.join(old.select(*names), names, "left_semi").select(*names)
    if twice.union(taken).limit(1).count():
        raise ValueError(f"duplicate {', '.join(names)} in the batch")
    return old.unionByName(new)


def supersede(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """rows (id, status) after pairs (old, new): the old is superseded, the new one lists what it supersedes."""
    gone = pairs.select(F.col("old").alias("id"), F.lit(True).alias("_gone")).distinct()
    listed = pairs.groupBy(F.col("new").alias("id")).agg(F.array_sort(F.collect_set("old")).alias("supersedes"))
    out = rows.join(gone, "id", "left").join(listed, "id", "left")
    return out.withColumn("status", F.when(F.col("_gone"), "superseded").otherwise(F.col("status"))).withColumn("supersedes", F.coalesce("supersedes", F.array().cast("array<bigint>"))).drop("_gone")


def learn(rows: DataFrame, most_chars: int, refused: Sequence[str], trust: Mapping[str, float], other_trust: float) -> DataFrame:
    """New memories from texts (id, text, source, base): blank, overlong and refused ones are left out, a text that comes again (without regard to case) corroborates its first id.

    confidence is the base (1 where unset) times the source's trust; repeats is how often the text came again.
    """
    length = F.length(F.trim("text"))
    fine = rows.where((length > 0) & (length <= most_chars) & ~F.col("source").isin(*refused)).withColumn("_h", F.sha2(F.lower(F.trim("text")), 256))
    first = fine.groupBy("_h").agg(F.min_by(F.struct(*rows.columns), F.col("id")).alias("r"), (F.count("*") - 1).alias("repeats")).select("r.*", "repeats")
    t = F.lit(other_trust)
    for source, value in trust.items():
        t = F.when(F.col("source") == source, value).otherwise(t)
    base = F.when(F.col("base") > 0, F.col("base")).otherwise(F.lit(1.0))
    return first.withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), base * t))).drop("base")


def open_goals(goals: DataFrame) -> DataFrame:
    """Goals (id, title) with defaults, the first of each title in folded form."""
    folded = F.lower(F.trim(F.regexp_replace("title", r"\s+", " ")))
    once = goals.groupBy(folded.alias("fingerprint")).agg(F.min_by(F.struct("id", "title"), F.col("id")).alias("r")).select("r.*", "fingerprint")
    return once.select("id", "title", "fingerprint", F.lit("active").alias("status"), F.lit(50).alias("priority"), F.lit(True).alias("auto_run"), F.lit(0.0).alias("progress"))


def patched(rows: DataFrame, changes: Mapping[str, Column]) -> DataFrame:
    """rows with new values, and whether any is another than before."""
    different = F.lit(False)
    for name, new in changes.items():
        different = different | ~new.eqNullSafe(F.col(name))
    return rows.withColumns({"changed": different, **{f"_{n}": v for n, v in changes.items()}}).drop(*changes).withColumnsRenamed({f"_{n}": n for n in changes})


def patch_counts(rows: DataFrame, changes: Mapping[str, Column]) -> DataFrame:
    """What a patch would do: matched, changed, skipped."""
    return patched(rows, changes).agg(F.count("*").alias("matched"), F.count_if(F.col("changed")).alias("changed"), F.count_if(~F.col("changed")).alias("skipped"))


def reconcile(old: DataFrame, new: DataFrame) -> DataFrame:
    """id and action (created, updated, unchanged, deleted) of two states (id, hash)."""
    both = old.select("id", F.col("hash").alias("_a"), F.lit(1).alias("_old")).join(new.select("id", F.col("hash").alias("_b"), F.lit(1).alias("_new")), "id", "full")
    action = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "deleted").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("updated")
    return both.select("id", action.alias("action"))


def apply_results(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """id and outcome of results (id, version, neighbours) held against their jobs (id, version, candidates): `stale`, `foreign_neighbour`, `unknown_job` or `applied`."""
    j = results.join(jobs.select("id", F.col("version").alias("_v"), "candidates"), "id", "left")
    foreign = F.size(F.array_except("neighbours", "candidates")) > 0
    return j.select("id", F.when(F.col("_v").isNull(), "unknown_job").when(F.col("version") != F.col("_v"), "stale").when(foreign, "foreign_neighbour").otherwise("applied").alias("outcome"), "neighbours")


def corroborated_evidence(evidence: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """memory_id, primary_id, primary_score, others, best: evidence (memory_id, primary_id, other_id) whose primary source (id, score) is known, with the number of its `most` best other sources and the best score of all."""
    primary = evidence.select("memory_id", "primary_id").distinct().join(sources.select(F.col("id").alias("primary_id"), F.col("score").alias("primary_score")), "primary_id")
    near = Window.partitionBy("memory_id", "primary_id").orderBy(F.desc("score"), "other_id")
    others = evidence.where("other_id <> primary_id").distinct().join(sources.select(F.col("id").alias("other_id"), "score"), "other_id").withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= most)
    found = others.groupBy("memory_id", "primary_id").agg(F.count("*").alias("others"), F.max("score").alias("_best"))
    j = primary.join(found, ["memory_id", "primary_id"], "left")
    return j.select("memory_id", "primary_id", "primary_score", F.coalesce("others", F.lit(0)).alias("others"), F.greatest("primary_score", F.coalesce("_best", F.lit(0.0))).alias("best"))


def authority_order(evidence: DataFrame) -> DataFrame:
    """evidence (draft_id, id, best, confidence, created_at) with rank: the best authority first, then confidence, then the latest, then least id; nulls last."""
    w = Window.partitionBy("draft_id").orderBy(F.col("best").desc_nulls_last(), F.col("confidence").desc_nulls_last(), F.col("created_at").desc_nulls_last(), "id")
    return evidence.withColumn("rank", F.row_number().over(w))


def corroborations(evidence: DataFrame) -> DataFrame:
    """corroborations, authoritative, origins (one row) of evidence (memory_id, source_id, origin, authoritative): distinct other origins of a memory than that of its least source; distinct authoritative sources; distinct origins."""
    first = evidence.groupBy("memory_id").agg(F.min_by("origin", "source_id").alias("_first"))
    pairs = evidence.select("memory_id", "origin").distinct().join(first, "memory_id").where(F.col("origin") != F.col("_first"))
    rest = evidence.agg(F.count_distinct(F.when(F.col("authoritative"), F.col("source_id"))).alias("authoritative"), F.count_distinct("origin").alias("origins"))
    return pairs.agg(F.count("*").alias("corroborations")).join(F.broadcast(rest))  # a row each


def mapping_mismatches(docs: DataFrame, category: int, name: str) -> DataFrame:
    """docs (labels, categories) that are mapped to the category and have labels, none of which has the leaf of its name."""
    leaf = T.category_leaf(F.lit(name))
    return docs.where(F.array_contains("categories", category) & (F.size("labels") > 0) & ~F.exists("labels", lambda x: T.category_leaf(x) == leaf))


def resolve(rows: DataFrame, by_id: DataFrame, by_title: DataFrame, prefix: str) -> DataFrame:
    """rows (target) with the page that the target names: by id, by title, by id with the prefix before it, else a stub. by_id, by_title: (key, page), keys in lower case."""
    key = F.lower(F.trim("target"))
    out = rows.withColumn("_k", key).withColumn("_p", F.concat(F.lit(prefix.lower()), "_k"))
    named = lambda df, on, name: df.groupBy(F.col("key").alias(on)).agg(F.min("page").alias(name))
    out = out.join(named(by_id, "_k", "_1"), "_k", "left").join(named(by_title, "_k", "_2"), "_k", "left").join(named(by_id, "_p", "_3"), "_p", "left")
    return out.withColumn("page", F.coalesce("_1", "_2", "_3", F.concat(F.lit("stub:"), "_k"))).drop("_k", "_p", "_1", "_2", "_3")


#: The keys under which an article may hold relations.
RELATION_KEYS = ("linked_items", "relations", "related", "related_articles", "references", "links", "connections", "associations")
_RELATION = "array<struct<kind:string,item_type:string,id:string,title:string,uri:string>>"


def relations(raw: Column) -> Column:
    """array(struct(kind, item_type, id, title, uri)) of an article's JSON: texts, objects or arrays of these under any of RELATION_KEYS; each kind, type and id once without regard to case."""
    parts = []
    for name in RELATION_KEYS:
        value = F.trim(F.get_json_object(raw, f"$.{name}"))
        listed = F.when(value.isNull() | (value == ""), F.array().cast("array<string>")).when(value.startswith("["), F.from_json(value, "array<string>")).otherwise(F.array(value))
        parts.append(F.transform(F.filter(listed, lambda x: x.isNotNull() & (F.trim(x) != "")), _relation(name)))
    found = F.filter(F.concat(*parts), lambda r: F.coalesce(r["id"], F.lit("")) != "").cast(_RELATION)
    keys = F.transform(found, lambda r: F.lower(F.concat_ws("|", r["kind"], F.coalesce(r["item_type"], F.lit("")), r["id"])))
    return F.filter(found, lambda r, i: F.array_position(keys, F.lower(F.concat_ws("|", r["kind"], F.coalesce(r["item_type"], F.lit("")), r["id"]))) == i + 1)


def _relation(kind: str) -> Callable[[Column], Column]:
    return lambda item: _as_relation(F.trim(item), kind)


def _as_relation(x: Column, kind: str) -> Column:
    first = lambda *keys: F.coalesce(*[F.nullif(F.trim(F.get_json_object(x, f"$.{k}")), F.lit("")) for k in keys])
    is_object = x.startswith("{")
    ident, title, item = first("id", "items_id", "item_id", "target_id", "knowledge_id"), first("title", "name", "label", "target_title"), first("item_type", "itemtype", "type")
    shown = F.coalesce(title, F.when(item.isNotNull() & ident.isNotNull(), F.concat(item, F.lit(" #"), ident)), ident)
    pick = lambda obj, text: F.when(is_object, obj).otherwise(text)
    none = F.lit(None).cast("string")
    return F.struct(
        pick(F.coalesce(first("relation", "kind"), F.lit(kind)), F.lit(kind)).alias("kind"), pick(item, none).alias("item_type"), pick(F.coalesce(ident, shown), x).alias("id"), pick(shown, x).alias("title"), pick(first("uri", "url", "source_uri", "href"), none).alias("uri"),
    )
