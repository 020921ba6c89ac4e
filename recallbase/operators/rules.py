"""Decisions as ordered gates: all checks are kept, the first that fails names the decision."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallbase.functions import exprs as X
from recallbase.functions import text as T

Gate = tuple[str, Column]


def decide(gates: Sequence[Gate], accepted: str) -> Column:
    """Code of the first gate (code, passes) that doesn't pass; null counts as not passed."""
    out = F.lit(accepted)
    for code, passes in reversed(list(gates)):
        out = F.when(F.coalesce(passes, F.lit(False)), out).otherwise(F.lit(code))
    return out


def checks(gates: Sequence[Gate]) -> Column:
    """array(struct(code, status, blocking)) of all gates."""
    return F.array(*[F.struct(F.lit(code).alias("code"), F.when(F.coalesce(p, F.lit(False)), "pass").otherwise("fail").alias("status"), (~F.coalesce(p, F.lit(False))).alias("blocking")) for code, p in gates])


@dataclass(frozen=True)
class ReplyPolicy:
    auto_category: bool = True
    category_confidence: float = 0.85
    auto_reply: bool = True
    reply_confidence: float = 0.9
    block_on_context_error: bool = True
    block_on_incident: bool = True
    sources: tuple[str, ...] = ()
    reply_sources: tuple[str, ...] = ()
    language: str = "de"
    style: str = "sie"
    knowledge_min_score: float = 0.8
    retrieval_floor: float = 0.35


def category_decision(p: ReplyPolicy, recommended: Column, current: Column, known: Column, confidence: Column) -> Column:
    return decide(
        [("category_auto_disabled", F.lit(p.auto_category)), ("category_no_recommendation", recommended != 0), ("category_already_correct", recommended != current), ("category_unknown", known), ("category_confidence_below_threshold", confidence >= p.category_confidence)],
        "category_accepted",
    )


def category_allowed(doc_categories: Column, effective: Column) -> Column:
    """Articles without categories fit anywhere."""
    return (F.size(doc_categories) == 0) | F.array_contains(doc_categories, effective)


def reply_gates(p: ReplyPolicy, c: dict[str, Column]) -> list[Gate]:
    """The gates of an automatic reply in order. c: candidates, allowed, confidence, knowledge_id, incomplete, incident, found, source, language, style, auto_reply, score, evidence, min_score, answer, categories, effective."""
    ci = lambda col, want: F.lower(F.trim(col)) == want.lower()
    return [
        ("reply_auto_disabled", F.lit(p.auto_reply)), ("reply_no_knowledge_candidates", c["candidates"] > 0), ("reply_model_not_recommended", c["allowed"]), ("reply_confidence_below_threshold", c["confidence"] >= p.reply_confidence),
        ("reply_no_knowledge_selected", F.coalesce(c["knowledge_id"], F.lit("")) != ""), ("reply_context_incomplete", ~(F.lit(p.block_on_context_error) & c["incomplete"])), ("reply_relevant_incident", ~(F.lit(p.block_on_incident) & c["incident"])),
        ("reply_knowledge_not_found", c["found"]), ("reply_source_not_allowed", F.lower(c["source"]).isin(*p.sources)), ("reply_source_not_allowed_for_auto_reply", F.lower(c["source"]).isin(*p.reply_sources)),
        ("reply_language_mismatch", ci(c["language"], p.language)), ("reply_style_mismatch", ci(c["style"], p.style)), ("reply_knowledge_auto_reply_not_approved", c["auto_reply"]), ("reply_knowledge_retrieval_below_floor", c["score"] >= p.retrieval_floor),
        ("reply_knowledge_evidence_below_threshold", c["evidence"] >= F.greatest(F.lit(p.knowledge_min_score), F.coalesce(c["min_score"], F.lit(0.0)))), ("reply_knowledge_answer_empty", F.trim(F.coalesce(c["answer"], F.lit(""))) != ""),
        ("reply_category_not_allowed", category_allowed(c["categories"], c["effective"])),
    ]


def priority_decision(current: Column, wanted: Column, confidence: Column, reasons: Column, allowed: Sequence[str], least: float, most_step: int) -> tuple[Column, Column]:
    """(decision, priority afterwards): only raises, with an allowed reason, no disallowed one and enough confidence, by `most_step` at most."""
    neutral = ("single_user_affected", "workaround_available", "insufficient_information")
    codes = F.array_distinct(F.transform(reasons, lambda r: F.lower(F.trim(r))))
    insufficient = F.array_contains(codes, "insufficient_information")
    acting = F.size(F.filter(codes, lambda r: r.isin(*allowed))) > 0
    clean = F.size(F.filter(codes, lambda r: ~r.isin(*allowed, *neutral))) == 0
    d = (
        F.when(~wanted.between(1, 6), "priority_invalid_recommendation").when(~current.between(1, 6), "priority_current_unknown").when(wanted < current, "priority_decrease_blocked")
        .when((wanted == current) & insufficient, "priority_no_change_insufficient_information").when(wanted == current, "priority_already_matches").when(insufficient, "priority_insufficient_information")
        .when(~(confidence >= least), "priority_confidence_below_threshold").when(~(acting & clean), "priority_reason_not_allowed").otherwise("priority_accepted")
    )
    capped = F.least(wanted, current + most_step if most_step > 0 else wanted, F.lit(6))
    return d, F.when(d == "priority_accepted", capped).otherwise(current)


def escalation_evidence(created: Column, last_human: Column, deadline: Column, assigned: Column, now: Column, inactivity_hours: float, risk_hours: float) -> dict[str, Column]:
    """Columns on age, inactivity, assignment and deadline of a ticket at `now`; null times give no evidence."""
    hours = lambda a, b: (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / F.lit(3_600_000_000.0)
    active = F.greatest(created, last_human)
    left = hours(now, deadline)
    return {
        "age_hours": hours(created, now), "inactive_hours": hours(active, now), "no_human_response": F.coalesce(hours(active, now) >= inactivity_hours, F.lit(False)), "unassigned": ~F.coalesce(assigned, F.lit(False)),
        "sla_breached": F.coalesce(left <= 0, F.lit(False)), "sla_at_risk": F.coalesce((left > 0) & (left <= risk_hours), F.lit(False)),
    }


def escalation_gates(age_hours: Column, least_age: float, needs_inactivity: Column, inactive: Column, escalate: Column, level: Column, most_level: int, confidence: Column, least: float, reasons: Column, allowed: Sequence[str]) -> list[Gate]:
    return [
        ("escalation_min_age_not_reached", age_hours >= least_age), ("escalation_human_activity_recent", ~needs_inactivity | inactive), ("escalation_not_recommended", escalate), ("escalation_level_not_allowed", level.between(1, most_level)),
        ("escalation_confidence_below_threshold", confidence >= least), ("escalation_reason_not_allowed", (F.size(reasons) > 0) & (F.size(F.filter(reasons, lambda r: ~r.isin(*allowed))) == 0)),
    ]


def status_reply(relevance: Column, confidence: Column, known: Column, kind: Column, least_relevance: float, least_confidence: float, least_final: float) -> tuple[Column, Column]:
    """(decision, final score) of a fixed reply to a status issue."""
    final = X.clamp(relevance, 0.0, 1.0) * X.clamp(confidence, 0.0, 1.0)
    d = decide([("status_reply_not_selected", known), ("status_reply_relevance_below_threshold", relevance >= least_relevance), ("status_reply_confidence_below_threshold", confidence >= least_confidence), ("status_reply_final_below_threshold", final >= least_final)], "accepted")
    return F.when(d == "accepted", F.when(kind == "maintenance", "reply_status_maintenance_accepted").otherwise("reply_status_incident_accepted")).otherwise(d), final


#: Signals in a ticket's text, in order; the first match of a code counts.
SIGNALS = (
    ("multiple_users_affected", r"\b(?:meine|unsere)\s+(?:kolleg(?:e|en|innen)|mitarbeiter(?:innen)?|teammitglieder)\s+und\s+ich\b"),
    ("multiple_users_affected", r"\b(?:kolleg(?:e|en|innen)|mitarbeiter(?:innen)?|benutzer|nutzer|personen)\s+und\s+ich\b"),
    ("multiple_users_affected", r"\b(?:mehrere|viele|alle|sämtliche)\s+(?:kolleg(?:en|innen)?|mitarbeiter(?:innen)?|benutzer|nutzer|personen|arbeitsplätze|rechner|pcs|geräte)\b"),
    ("multiple_users_affected", r"\bwir\s+alle\b"),
    ("site_affected", r"\b(?:gesamter|ganzer|kompletter)\s+(?:standort|gebäude|liegenschaft|campus)\b"),
    ("organization_affected", r"\b(?:gesamte|ganze|komplette)\s+(?:organisation|verwaltung|behörde|firma|unternehmen)\b"),
    ("workaround_available", r"\b(?:workaround|ausweichmöglichkeit|alternative(?:r|n)?\s+weg|ersatzlösung)\b"),
    ("workaround_available", r"\b(?:andere|weitere|alternative)\s+(?:drucker|geräte|systeme|anwendungen?)\b.{0,60}\b(?:funktionier(?:t|en)|lauf(?:en|t)|geh(?:t|en))\b"),
    ("workaround_available", r"\b(?:büro|arbeitsplatz)[- ]?drucker\b.{0,50}\b(?:funktionier(?:t|en)|lauf(?:en|t)|geh(?:t|en)|noch\s+verfügbar)\b"),
    ("no_workaround", r"\b(?:kein(?:e|en)?\s+(?:workaround|alternative|ausweichmöglichkeit)|ohne\s+ausweichmöglichkeit|überhaupt\s+nicht\s+weiterarbeiten)\b"),
    ("business_deadline", r"\b(?:frist|deadline|abgabetermin|termin)\b.{0,60}\b(?:heute|morgen|bis\s+\d{1,2}[./-]\d{1,2}|dringend|läuft\s+ab)\b"),
    ("security_incident_suspected", r"\b(?:phishing|ransomware|schadsoftware|malware|konto\s+übernommen|unbefugter\s+zugriff|datenabfluss)\b"),
    ("data_loss_possible", r"\b(?:datenverlust|daten\s+verloren|dateien\s+gelöscht|nicht\s+gespeichert|überschrieben)\b"),
)
#: What the borders in SIGNALS mean, borders of ASCII words; Java's own look at all letters.
_BORDER = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def signals(tickets: DataFrame) -> DataFrame:
    """ticket_id, code, excerpt: the first rule of each code that a ticket's subject and content (null counts as empty) match, with 90 characters around.

    Both are read as one text without tags, entities and runs of white space.
    """
    text = F.concat_ws("\n", F.coalesce("subject", F.lit("")), F.coalesce("content", F.lit("")))
    text = F.regexp_replace(F.regexp_replace(text, r"<br ?/?>|</p>|</li>", "\n"), r"(?s)<[^>]*>", " ")
    for entity, plain in T.ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(plain))
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    rows = tickets.select("ticket_id", text.alias("t"))
    pattern = lambda p: "(?iu)" + p.replace(r"\b", _BORDER)
    found = F.array(*[F.struct(F.lit(code).alias("code"), F.regexp_instr("t", F.lit(pattern(p))).alias("at"), F.length(F.regexp_extract("t", pattern(p), 0)).alias("size")) for code, p in SIGNALS])
    met = F.filter(found, lambda s: s["at"] > 0)
    first = T.once(met, lambda hits: F.filter(hits, lambda s, i: F.array_position(F.transform(hits, lambda x: x["code"]), s["code"]) == i + 1))  # as many as there are rules
    left, end = F.greatest(F.col("s.at") - 90, F.lit(1)), F.col("s.at") + F.col("s.size") + 90
    around = F.concat(F.when(left > 1, "…").otherwise(""), F.trim(F.substring("t", left, end - left)), F.when(end <= F.length("t"), "…").otherwise(""))
    return rows.select("ticket_id", "t", F.explode(first).alias("s")).select("ticket_id", "s.code", around.alias("excerpt"))


def publication_gate(evidence: Column, sources: Column, corroborations: Column, authoritative: Column, new: Column, least=(3, 2, 1, 1)) -> Column:
    """May a draft be published? Enough evidence, sources, independent corroborations and authority, and something new."""
    return decide([("insufficient_evidence", evidence >= least[0]), ("insufficient_sources", sources >= least[1]), ("insufficient_corroboration", corroborations >= least[2]), ("no_authoritative_source", authoritative >= least[3]), ("no_new_information", new)], "publish")


#: Escalation actions in the order in which they are carried out.
ACTION_ORDER = ("assign_security_team", "link_major_incident", "assign_second_level", "raise_priority", "notify_service_owner", "request_manager_review")


def escalation_actions(actions: Column) -> Column:
    """The first three distinct actions (trimmed, lower case, without `none`) in the fixed order, unknown ones last by name."""
    clean = F.filter(F.array_distinct(F.transform(actions, lambda a: F.lower(F.trim(a)))), lambda a: (a != "") & (a != "none"))
    order = F.array(*[F.lit(a) for a in ACTION_ORDER])
    ranked = F.array_sort(F.transform(F.slice(clean, 1, 3), lambda a: F.struct(F.when(F.array_position(order, a) > 0, F.array_position(order, a)).otherwise(F.lit(100)).cast("int").alias("n"), a.alias("a"))))
    return F.transform(ranked, lambda r: r["a"])


def reason_codes(codes: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(codes, lambda c: F.lower(F.trim(c))), lambda c: c != ""))


def unsupported_reasons(codes: Column, evidence: dict[str, Column]) -> Column:
    """Reasons that the evidence contradicts; reasons that no evidence column is named after are left alone."""
    bad = F.array(*[F.when(~F.coalesce(held, F.lit(False)), F.lit(name)) for name, held in evidence.items()])
    return F.filter(reason_codes(codes), lambda c: F.array_contains(F.filter(bad, lambda b: b.isNotNull()), c))


#: Signals that take precedence over a model's reasons, in order; each is put before those already there.
PRECEDENCE = ("organization_affected", "site_affected", "multiple_users_affected", "workaround_available", "no_workaround", "business_deadline", "security_incident_suspected", "data_loss_possible")


def reconcile_reasons(reasons: Column, signals: Column) -> Column:
    """At most three reasons after the signals of the text had their say; without any, `insufficient_information`."""
    own = reason_codes(reasons)
    own = F.when(F.size(signals) > 0, F.array_remove(own, "insufficient_information")).otherwise(own)
    first = F.filter(F.array(*[F.lit(c) for c in reversed(PRECEDENCE)]), lambda c: F.array_contains(signals, c) & ~F.array_contains(own, c))
    both = F.concat(first, own)
    lacking = (F.size(both) == 0) | F.array_contains(both, "insufficient_information")
    return F.when(lacking, F.array(F.lit("insufficient_information"))).otherwise(F.slice(both, 1, 3))


def reconciled_scope(scope: Column, signals: Column) -> Column:
    has = lambda c: F.array_contains(signals, c)
    return (
        F.when(has("organization_affected"), "organization").when(has("site_affected"), F.when(scope == "organization", scope).otherwise("site"))
        .when(has("multiple_users_affected"), F.when(scope.isin("organization", "site"), scope).otherwise("multiple_users")).otherwise(scope)
    )


def trend_text(title: Column, evaluation: Column, progress: Column) -> Column:
    """A sentence on where a goal is heading."""
    trend = F.when(evaluation >= 0.35, "positive").when(evaluation <= -0.35, "at risk").otherwise("uncertain")
    return F.format_string('Current evidence indicates a %s trajectory for "%s" (score %.2f, progress %.0f%%).', trend, title, evaluation, progress * 100)


def version_processed(outcome: Column, error: Column, trigger: Column, version: Column) -> Column:
    """Did a run settle a ticket's version? Not if it failed, was scheduled or knows no version."""
    return ~((outcome == "error") | (error != "") | (F.lower(trigger) == "scheduled_escalation")) & (version != "")


#: Beginnings of failures that another attempt would repeat.
DETERMINISTIC_FAILURES = (
    "staging synthesis ", "invalid staging synthesis ", "staging article too ", "staging answer too ", "invalid expanded staging ", "claim verification ", "staging source authority ",
    "staging evidence diversity ", "no active, goal-relevant ", "staging quality gate ",
)


def deterministic_failure(message: Column) -> Column:
    m = F.lower(F.trim(message))
    out = m.contains("source-unverified identifiers")
    for head in DETERMINISTIC_FAILURES:
        out = out | m.startswith(head)
    return out


def article_bounds(text: Column, answer: Column, text_range: tuple[int, int], answer_range: tuple[int, int]) -> Column:
    """What is wrong with the lengths of an article and its answer; null if nothing is."""
    t, a = F.length(F.trim(F.coalesce(text, F.lit("")))), F.length(F.trim(F.coalesce(answer, F.lit(""))))
    return F.when(t < text_range[0], "article too short").when(t > text_range[1], "article too long").when(a < answer_range[0], "answer too short").when(a > answer_range[1], "answer too long")


def status_reply_kind(kind: Column, status: Column) -> Column:
    """`maintenance`, `incident` or null, for which there is no fixed reply."""
    k, s = F.lower(kind), F.lower(F.trim(status))
    return F.when((k == "maintenance") | (s == "maintenance"), "maintenance").when((k == "pinned_incident") | s.isin("down", "pending", "incident"), "incident")


def auto_reply_approval(enabled: bool, allow_uncategorized: bool, categories: Column, article: Column, allowed: Sequence[int], allowed_articles: Sequence[int]) -> Column:
    """struct(approved, reason) of an article by the categories of its source."""
    says = lambda ok, why: F.struct(F.lit(ok).alias("approved"), F.lit(why).alias("reason"))
    if not enabled:
        return says(False, "auto_reply_disabled")
    hit = F.arrays_overlap(categories, F.array(*[F.lit(int(c)) for c in allowed]).cast("array<bigint>")) if allowed else F.lit(False)
    bare = says(False, "article_without_category") if not allow_uncategorized else F.when(article.isin(*allowed_articles), says(True, "uncategorized_article_approved")).otherwise(says(False, "uncategorized_article_not_whitelisted"))
    return F.when(F.size(categories) == 0, bare).when(hit, says(True, "auto_reply_approved")).otherwise(says(False, "category_not_whitelisted" if allowed else "auto_reply_whitelist_empty"))


#: Words of a category's name and what tickets of it are about.
CATEGORY_HINTS = (
    (("active directory", "entra", "identity", "benutzerkonto", "account"), ("Benutzerkonto", "Anmeldung / Login", "Konto gesperrt", "Passwort", "Domänenkonto", "Gruppen und Berechtigungen", "Authentifizierung")),
    (("druck", "printer"), ("Drucker", "Drucken nicht möglich", "Druckwarteschlange", "Netzwerkdrucker", "Toner", "Papierstau")),
    (("vpn",), ("VPN-Verbindung", "Remote Access", "Gateway", "GlobalProtect", "Tunnel", "Verbindungsaufbau")),
    (("mail", "outlook", "exchange"), ("E-Mail", "Outlook", "Postfach", "E-Mail Versand und Empfang", "Exchange")),
    (("netz", "network", "wlan", "wifi"), ("Netzwerk", "LAN", "WLAN", "Keine Verbindung", "DNS", "IP-Adresse")),
    (("hardware", "client", "arbeitsplatz"), ("Arbeitsplatzgerät", "Notebook", "PC", "Dockingstation", "Peripherie")),
)


def category_hints(name: Column) -> Column:
    """Hints of all rules that a category's name meets, distinct in order."""
    low, parts = F.lower(name), []
    for marks, hints in CATEGORY_HINTS:
        met = F.lit(False)
        for mark in marks:
            met = met | low.contains(mark)
        parts.append(F.when(met, F.array(*[F.lit(h) for h in hints])).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*parts))
