"""The decision on a ticket as one plan: candidates, what the model may see, category and reply, the audit of each; what people made of it afterwards."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallbase.functions import exprs as X
from recallbase.functions import text as T
from recallbase.operators import rules as R


@dataclass(frozen=True)
class Settings:
    """most, floor and gap of the candidates; least confidence of a category and a reply; least evidence; sources that the model may see, and that may be answered from."""

    most: int = 6
    floor: float = 0.3
    gap: float = 0.2
    category_confidence: float = 0.5
    reply_confidence: float = 0.5
    evidence: float = 0.5
    sources: Sequence[str] = ()
    reply_sources: Sequence[str] = ()


def selection_reason(rank: Column, score: Column, sent: Column, cutoff: Column, floor: float, most: int) -> Column:
    """Why a candidate was sent to the model, or not; `most` 0 or less is no limit."""
    over = (rank > most) if most > 0 else F.lit(False)
    return F.when(sent, "sent_to_ai").when(score < floor, "below_retrieval_floor").when(score < cutoff, "outside_candidate_gap").when(over, "max_candidates_reached").otherwise("not_selected")


def candidates(hits: DataFrame, s: Settings) -> DataFrame:
    """hits (ticket_id, id, source, score) of the allowed sources with rank, cutoff, sent and reason. Ties go to the smaller id; a best hit under the floor sends none."""
    rows = hits.where(F.lower(F.trim("source")).isin(*[x.strip().lower() for x in s.sources])) if s.sources else hits
    best = Window.partitionBy("ticket_id").orderBy(F.desc("score"), "id")
    ranked = rows.withColumn("rank", F.row_number().over(best)).withColumn("best", F.max("score").over(Window.partitionBy("ticket_id")))
    ranked = ranked.withColumn("cutoff", F.greatest(F.lit(s.floor), F.col("best") - s.gap))
    number = F.col("rank") <= s.most if s.most > 0 else F.lit(True)
    sent = (F.col("best") >= s.floor) & (F.col("score") >= F.col("cutoff")) & number
    ranked = ranked.withColumn("sent", sent)
    return ranked.withColumn("reason", selection_reason(F.col("rank"), F.col("score"), F.col("sent"), F.col("cutoff"), s.floor, s.most)).drop("best")


def process(tickets: DataFrame, hits: DataFrame, answers: DataFrame, s: Settings) -> DataFrame:
    """A row per ticket: candidates sent, category_decision, new_category, reply_decision, reply_id, evidence.

    tickets: (ticket_id, open, category_id, known_categories array). hits: (ticket_id, id, source, score, categories array,
    approved). answers, of the model: (ticket_id, category_id, category_confidence, reply_id, reply_allowed,
    reply_confidence); a ticket has at most one. A closed ticket is left alone, one without an answer waits. The category
    comes first, as a reply rests on the category that holds after it. Repeated tickets give repeated rows.
    """
    ranked = candidates(hits, s)
    sent = ranked.groupBy("ticket_id").agg(F.count_if("sent").alias("candidates_sent"))
    a = answers.select("ticket_id", F.col("category_id").alias("wanted"), "category_confidence", "reply_id", "reply_allowed", "reply_confidence")
    chosen = ranked.select("ticket_id", F.col("id").alias("reply_id"), F.lit(True).alias("found"), "sent", "score", "source", "categories", "approved")
    t = tickets.join(sent, "ticket_id", "left").join(a, "ticket_id", "left").join(chosen, ["ticket_id", "reply_id"], "left")
    c = F.col
    there = c("category_confidence").isNotNull() | c("reply_confidence").isNotNull()
    category = R.decide([
        ("ticket_not_open", F.coalesce(c("open"), F.lit(False))), ("model_answer_missing", there), ("category_not_recommended", c("wanted") > 0), ("category_unknown", F.array_contains("known_categories", c("wanted"))),
        ("category_unchanged", c("wanted") != F.coalesce("category_id", F.lit(0))), ("category_confidence_below_threshold", c("category_confidence") >= s.category_confidence),
    ], "category_accepted")
    t = t.withColumn("category_decision", category).withColumn("effective", F.when(c("category_decision") == "category_accepted", c("wanted")).otherwise(c("category_id")))
    t = t.withColumn("evidence", X.evidence_score(F.coalesce("score", F.lit(0.0)), F.coalesce("reply_confidence", F.lit(0.0)), F.when(R.category_allowed(c("categories"), c("effective")), 1.0).otherwise(0.0), F.size("categories") > 0))
    may_answer = F.lower(F.trim("source")).isin(*[x.strip().lower() for x in s.reply_sources]) if s.reply_sources else F.lit(True)
    reply = R.decide([
        ("ticket_not_open", F.coalesce(c("open"), F.lit(False))), ("model_answer_missing", there), ("reply_no_knowledge_candidates", F.coalesce("candidates_sent", F.lit(0)) > 0), ("reply_model_not_recommended", c("reply_allowed")), ("reply_confidence_below_threshold", c("reply_confidence") >= s.reply_confidence),
        ("reply_no_knowledge_selected", c("reply_id").isNotNull()), ("reply_knowledge_not_found", c("found")), ("reply_knowledge_not_sent", c("sent")), ("reply_source_not_allowed", may_answer), ("reply_knowledge_auto_reply_not_approved", c("approved")),
        ("reply_category_mismatch", R.category_allowed(c("categories"), c("effective"))), ("reply_knowledge_evidence_below_threshold", c("evidence") >= s.evidence),
    ], "reply_accepted")
    t = t.withColumn("reply_decision", reply)
    return t.select("ticket_id", F.coalesce("candidates_sent", F.lit(0)).alias("candidates_sent"), "category_decision", F.when(c("category_decision") == "category_accepted", c("wanted")).alias("new_category"), "reply_decision", F.when(c("reply_decision") == "reply_accepted", c("reply_id")).alias("reply_id"), F.when(c("found"), c("evidence")).alias("evidence"))


def diagnose(asked: DataFrame, hits: DataFrame, s: Settings) -> DataFrame:
    """Why an article was or wasn't seen for a ticket: rank, score, cutoff, sent, reason and failed (the checks that it failed, in order) of each asked (ticket_id, id).

    An article among the hits whose source isn't allowed has rank 0 and is held against the cutoff of the allowed ones; one that isn't among the hits has the reason `not_in_active_index`.
    """
    ranked = candidates(hits, s)
    bounds = ranked.groupBy("ticket_id").agg(F.first("cutoff").alias("_cutoff"))
    own = ranked.select("ticket_id", "id", "rank", "sent")
    every = hits.select("ticket_id", "id", "score", F.lit(True).alias("found"))
    j = asked.join(every, ["ticket_id", "id"], "left").join(own, ["ticket_id", "id"], "left").join(bounds, "ticket_id", "left")
    c = F.col
    allowed, cutoff, sent = c("rank").isNotNull(), F.coalesce("_cutoff", F.lit(s.floor)), F.coalesce("sent", F.lit(False))
    why = selection_reason(F.coalesce("rank", F.lit(0)), c("score"), sent, cutoff, s.floor, s.most)
    reason = F.when(c("found").isNull(), "not_in_active_index").when(~allowed, "source_not_allowed_for_purpose").otherwise(why)
    gates = [("candidate_in_active_index", c("found").isNotNull()), ("candidate_source_for_purpose", allowed), ("candidate_retrieval_floor", allowed & (c("score") >= s.floor)), ("candidate_dynamic_cutoff", allowed & (c("score") >= cutoff)), ("candidate_sent_to_ai", sent)]
    failed = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in gates]), lambda x: x.isNotNull())
    return j.select("ticket_id", "id", F.coalesce("rank", F.lit(0)).alias("rank"), "score", cutoff.alias("cutoff"), sent.alias("sent"), reason.alias("reason"), failed.alias("failed"))


def record_outcomes(runs: DataFrame, said: DataFrame) -> DataFrame:
    """What technicians said of runs, checked: id, run_id, state, decision, confirmed, category_id, knowledge_id, actor, sync_status, supersedes.

    runs: (run_id, source_version, fresh_version, proposed, input, basis_category, ai_category, category_before, ai_knowledge,
    knowledge). said: (id, run_id, at, decision, corrected, actor). state is `recorded`, or why it was refused: no such run, a
    ticket that changed since, no proposal, an unknown decision, a correction without a text, no input. A repeat of what was
    last recorded for its run is `repeated` and not learned again; another outcome supersedes it.
    """
    c, text = F.col, (lambda name: F.trim(F.coalesce(name, F.lit(""))))
    j = said.join(runs.withColumn("_run", F.lit(True)), "run_id", "left").withColumn("decision", F.lower(text("decision")))
    accepted = c("decision") == "accepted"
    state = R.decide([
        ("run_not_found", c("_run")), ("ticket_changed", (text("source_version") == "") | c("source_version").eqNullSafe(c("fresh_version"))), ("no_reply_proposal", text("proposed") != ""), ("unknown_decision", c("decision").isin("accepted", "corrected")),
        ("correction_without_text", accepted | (text("corrected") != "")), ("no_learning_input", text("input") != ""),
    ], "recorded")
    confirmed = F.substring(F.trim(F.regexp_replace(T.strip_tags(F.when(accepted, text("proposed")).otherwise(text("corrected"))), r"\s+", " ")), 1, 12_000)
    category = F.when(c("basis_category") > 0, c("basis_category")).when(c("ai_category") > 0, c("ai_category")).otherwise(c("category_before"))
    knowledge = F.when(text("ai_knowledge") != "", text("ai_knowledge")).otherwise(text("knowledge"))
    rows = j.select("id", "run_id", "at", state.alias("state"), "decision", confirmed.alias("confirmed"), category.alias("category_id"), knowledge.alias("knowledge_id"), F.when(text("actor") != "", text("actor")).otherwise("technician").alias("actor"))
    order = Window.partitionBy("run_id", "state").orderBy("at", "id")
    same = F.struct("decision", "confirmed")
    good = F.col("state") == "recorded"
    rows = rows.withColumn("state", F.when(good & same.eqNullSafe(F.lag(same).over(order)), "repeated").otherwise(c("state")))
    supersedes = F.when(c("state") == "recorded", F.lag("id").over(order))
    return rows.select("id", "run_id", "state", "decision", "confirmed", "category_id", "knowledge_id", "actor", F.when(c("state") == "recorded", "pending").alias("sync_status"), supersedes.alias("supersedes"))


def outcome_memory(outcomes: DataFrame, system: str) -> DataFrame:
    """id, text, tags, source, confidence, salience of the memory that a recorded outcome becomes; system: the lower-case name of the ticket system. outcomes: (id, ticket_id, run_id, decision, input, confirmed, category_id, category_name, knowledge_id, supersedes)."""
    c, s = F.col, (lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")))
    named, numbered = s("category_name") != "", F.coalesce(c("category_id") > 0, F.lit(False))
    category = F.when(named | numbered, F.concat(F.lit("\n\nCategory: "), s("category_name"), F.when(numbered, F.concat(F.lit(" (#"), s("category_id"), F.lit(")"))).otherwise(""))).otherwise("")
    text = F.concat(F.lit(f"{system.upper()} helpdesk outcome verified by a technician.\n\nProblem:\n"), s("input"), F.lit("\n\nVerified solution:\n"), s("confirmed"), category)
    tag = lambda prefix, name, there=None: F.when(F.lit(True) if there is None else there, F.concat(F.lit(prefix), s(name)))
    tags = F.array(F.lit(f"integration:{system}"), F.lit("validated:human"), tag("outcome:", "decision"), tag("ticket:", "ticket_id"), tag("run:", "run_id"), tag("category:", "category_id", numbered), tag("knowledge:", "knowledge_id", s("knowledge_id") != ""), tag("supersedes-outcome:", "supersedes", s("supersedes") != ""))
    return outcomes.select("id", text.alias("text"), F.filter(tags, lambda x: x.isNotNull()).alias("tags"), F.concat(F.lit(f"{system}.outcome."), s("decision")).alias("source"), F.when(c("decision") == "corrected", 1.0).otherwise(0.99).alias("confidence"), F.lit(1.2).alias("salience"))


def event_metadata(metadata: Column, query: Column, hits: Column, most: int = 8) -> Column:
    """The map of an integration event: its own entries with a name, the query if there is one, the number of hits (structs id, score) and the first `most` of them as id:score."""
    own = F.filter(F.coalesce(F.map_entries(metadata), F.array().cast("array<struct<key:string,value:string>>")), lambda e: F.trim(e["key"]) != "")
    entry = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    asked = F.when(F.trim(F.coalesce(query, F.lit(""))) != "", F.array(entry(F.lit("query"), query)))
    n = F.coalesce(F.size(hits), F.lit(0))
    counted = F.when(n > 0, F.array(entry(F.lit("hit_count"), n.cast("string"))))
    first = F.transform(F.slice(hits, 1, most), lambda h, i: entry(F.concat(F.lit("hit_"), (i + 1).cast("string")), F.format_string("%s:%.4f", h["id"].cast("string"), h["score"].cast("double"))))
    none = F.array().cast("array<struct<key:string,value:string>>")
    added = F.concat(F.coalesce(asked, none), F.coalesce(counted, none), F.coalesce(first, none))
    kept = F.filter(own, lambda e: ~F.array_contains(F.transform(added, lambda x: x["key"]), e["key"]))
    return F.map_from_entries(F.concat(kept, added))


def feedback(rows: DataFrame, agreed: Column) -> DataFrame:
    """n, agreed, corrected, rate (one row): how often people kept what was recommended. Rows without an answer (null) count in n alone."""
    return rows.select(agreed.alias("_a")).agg(F.count("*").alias("n"), F.count_if("_a").alias("agreed"), F.count_if(~F.col("_a")).alias("corrected"), F.avg(F.col("_a").cast("double")).alias("rate"))


def effective_category(tickets: DataFrame, categories: DataFrame) -> DataFrame:
    """tickets (with category_id) with the name of their category (id, name), and a stand-in with its number where it has none."""
    named = tickets.join(categories.select(F.col("id").alias("category_id"), F.col("name").alias("category")), "category_id", "left")
    return named.withColumn("category", F.coalesce("category", F.concat(F.lit("Kategorie #"), F.col("category_id").cast("string"))))


def common_digest(rows: DataFrame, key: str) -> DataFrame:
    """key, digest, mismatch: the one digest that all nodes (key, digest) with one report, or a mismatch and no digest. Blank digests are passed over."""
    d = F.trim(F.coalesce("digest", F.lit("")))
    g = rows.groupBy(key).agg(F.count_distinct(F.when(d != "", d)).alias("n"), F.max(F.when(d != "", d)).alias("d"))
    return g.select(key, F.when(F.col("n") <= 1, F.coalesce("d", F.lit(""))).otherwise("").alias("digest"), (F.col("n") > 1).alias("mismatch"))


def suspicious_ids(configured: DataFrame, items: DataFrame, itil: DataFrame) -> DataFrame:
    """Configured category ids (id) that no article (categories array) has but ticket categories (id) do: they were probably meant for the other kind."""
    known = items.select(F.explode("categories").alias("id")).distinct()
    return configured.select("id").distinct().join(known, "id", "left_anti").join(itil.select("id").distinct(), "id", "left_semi")


def save_mapping(rows: DataFrame) -> DataFrame:
    """normalized, label, ids of a category mapping to be stored from rows (label, ids array): labels folded, ids of equal ones joined, entries without ids dropped.

    The shown label is the least spelling. A blank label or an id below 1 refuses all.
    """
    bad = rows.where((F.trim(F.coalesce("label", F.lit(""))) == "") | F.exists("ids", lambda i: i <= 0)).limit(1).count()
    if bad:
        raise ValueError("a category mapping has a blank label or an invalid id")
    key = F.lower(F.trim(F.regexp_replace("label", r"\s+", " ")))
    g = rows.where(F.size("ids") > 0).groupBy(key.alias("normalized")).agg(F.min(F.trim("label")).alias("label"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    return g.select("normalized", "label", "ids")


def mapping_usage(docs: DataFrame, mapping: DataFrame) -> DataFrame:
    """normalized, label, used, ids, observed, configured, state of every label that documents (id, labels array) or a stored mapping have. used counts documents; state: `mapped`, `unmapped`, `orphan`. The spelling in the documents comes first."""
    key = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    seen = docs.select("id", F.explode("labels").alias("label")).where(F.trim("label") != "").groupBy(key(F.col("label")).alias("normalized")).agg(F.count_distinct("id").alias("used"), F.min(F.trim("label")).alias("_seen"))
    j = seen.join(mapping.select("normalized", F.col("label").alias("_told"), "ids"), "normalized", "full")
    observed, n = F.col("used").isNotNull(), F.size(F.coalesce("ids", F.array().cast("array<bigint>")))
    state = F.when(~observed, "orphan").when(n > 0, "mapped").otherwise("unmapped")
    return j.select("normalized", F.coalesce("_seen", "_told").alias("label"), F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"), observed.alias("observed"), F.col("_told").isNotNull().alias("configured"), state.alias("state"))


def mapped_documents(docs: DataFrame, mapping: DataFrame) -> DataFrame:
    """id, ids, unmapped of documents (id, labels array) under a stored mapping: nothing else of a document changes, so nothing else is done again."""
    key = F.lower(F.trim(F.regexp_replace("label", r"\s+", " ")))
    told = docs.select("id", F.explode_outer("labels").alias("label")).withColumn("normalized", key).join(mapping.select("normalized", "ids"), "normalized", "left")
    none = F.array().cast("array<bigint>")
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("ids", none)))))
    return told.groupBy("id").agg(ids.alias("ids"), F.array_sort(F.collect_set(F.when(F.col("ids").isNull() & (F.trim("label") != ""), F.trim("label")))).alias("unmapped"))
