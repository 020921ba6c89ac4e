"""Scalar column builders: numbers, vectors, scores, hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def unset(value: Column, default: float) -> Column:
    """value, or the default where it is null, zero or negative."""
    return F.when(value > 0, value).otherwise(F.lit(default))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed in order."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, degenerate: float = -1.0) -> Column:
    """Cosine; `degenerate` for empty vectors, unequal lengths and zero norms."""
    aa, bb = dot(a, a), dot(b, b)
    fine = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (aa > 0) & (bb > 0)
    return F.when(fine, dot(a, b) / (F.sqrt(aa) * F.sqrt(bb))).otherwise(F.lit(degenerate))


def l2_normalize(v: Column) -> Column:
    """The vector over its length; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def searchable(status: Column) -> Column:
    """Memories that a search may return: status unset, active or conflicted."""
    return F.coalesce(status, F.lit("")).isin("", "active", "conflicted")


#: Weight of a memory type in a search; others weigh 1.
TYPE_WEIGHTS = {"episodic": 1.0, "semantic": 1.15, "procedural": 1.20, "working": 0.85}


def type_weight(memory_type: Column, weights: dict[str, float] = TYPE_WEIGHTS) -> Column:
    out = F.lit(1.0)
    for name, weight in weights.items():
        out = F.when(memory_type == name, F.lit(weight)).otherwise(out)
    return out


def base_score(similarity: Column, salience: Column, confidence: Column, weight: Column) -> Column:
    return similarity * (0.75 + 0.25 * salience) * weight * (0.85 + 0.15 * unset(confidence, 1.0))


def knowledge_score(confidence: Column, reward: Column, salience: Column) -> Column:
    """How far a memory is to be believed against others on the same truth key."""
    return 0.55 * unset(confidence, 1.0) + 0.25 * clamp((reward + 1) / 2, 0, 1) + 0.20 * clamp(unset(salience, 1.0) / 2, 0, 1)


def age_days(then: Column, now: str) -> Column:
    """Days from a timestamp (without zone) to the literal time `now`."""
    seconds = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(then.cast("timestamp"))
    return seconds / F.lit(86_400_000_000.0)


def memory_utility(age: Column, access_count: Column, salience: Column, confidence: Column, reward: Column) -> Column:
    """What a memory is worth to retention; age in days since its last access."""
    fresh = F.exp(-F.greatest(age, F.lit(0.0)) / 30)
    used = F.least(F.lit(1.0), F.log1p(access_count.cast("double")) / 4)
    return 0.30 * fresh + 0.20 * used + 0.20 * clamp(salience / 2, 0, 1) + 0.20 * clamp(unset(confidence, 1.0), 0, 1) + 0.10 * clamp((reward + 1) / 2, 0, 1)


def display_priority(salience: Column, confidence: Column, access_count: Column, active: Column, outcome: Column, integration: Column) -> Column:
    bonus = F.when(active, 0.5).otherwise(0.0) + F.when(outcome, 1.0).otherwise(0.0) + F.when(integration, 0.4).otherwise(0.0)
    return salience + 0.5 * confidence + 0.01 * access_count + bonus


def decayed(weight: Column, rate: float, days: Column) -> Column:
    """weight * (1 - rate)^days; nothing is left when the rate is 1 or more."""
    left = 1.0 - rate
    return weight * (F.pow(F.lit(left), F.greatest(days, F.lit(0.0))) if left > 0 else F.lit(0.0))


def weighted_mean(parts: Sequence[tuple[Column, float, Column]]) -> Column:
    """Weighted mean over (value, weight, available) of the parts that are available; 0 if none is."""
    total, weights = F.lit(0.0), F.lit(0.0)
    for value, weight, available in parts:
        if weight > 0:
            total = total + F.when(available, clamp(value, 0.0, 1.0) * weight).otherwise(0.0)
            weights = weights + F.when(available, F.lit(float(weight))).otherwise(0.0)
    return F.when(weights > 0, clamp(total / weights, 0.0, 1.0)).otherwise(0.0)


def evidence_score(retrieval: Column, confidence: Column, alignment: Column, aligned: Column, weights=(0.45, 0.35, 0.20)) -> Column:
    return weighted_mean([(retrieval, weights[0], F.lit(True)), (confidence, weights[1], F.lit(True)), (alignment, weights[2], aligned)])


def edge_ends(a: Column, b: Column) -> tuple[Column, Column]:
    """An undirected edge's ends in order."""
    return F.least(a, b), F.greatest(a, b)


def memory_type_of(kind: Column) -> Column:
    """The memory type that a kind implies."""
    k = F.lower(F.trim(kind))
    return F.when(k.isin("user", "assistant", "event", "experience", "episode"), "episodic").when(k.isin("procedure", "procedural", "rule", "instruction"), "procedural").when(k.isin("working", "scratch"), "working").otherwise("semantic")


def histogram_p95(count: Column, buckets: Sequence[tuple[float, Column]]) -> Column:
    """Upper bound, in milliseconds, of the first cumulative bucket that holds 95 % of the count; the last one's if none does."""
    need = F.ceil(count * 0.95)
    out = F.lit(buckets[-1][0] * 1000)
    for bound, cumulative in reversed(buckets):
        out = F.when(cumulative >= need, F.lit(bound * 1000)).otherwise(out)
    return out


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def risk_class(nodes: Column, components: Column, routes: Column, services: Column) -> Column:
    """Risk of a change by what it reaches."""
    return F.when((services > 1) | (components > 2) | (routes > 4) | (nodes >= 120), "high").when((services > 0) | (components > 1) | (routes > 0) | (nodes >= 35), "medium").otherwise("low")


def policy_confidence(base: Column, trust: Column) -> Column:
    """A source's trust times the base confidence, which is 1 where unset."""
    return clamp(unset(base, 1.0) * trust, 0.0, 1.0)


def auto_reward(question_answer: Column, alignment: Column) -> Column:
    """Reward of an answer: its similarity to the question, and the mean positive similarity of what it was based on (null: none)."""
    return clamp((0.7 * question_answer + 0.3 * F.coalesce(alignment, question_answer) - 0.10) / 0.80, -1.0, 1.0)


def retry_minutes(interval: Column, errors: Column) -> Column:
    """Minutes until a goal is tried again: doubled with each error, five times at most, a day at most."""
    return F.least(F.lit(1440), F.greatest(F.lit(1), (interval * F.pow(F.lit(2.0), F.least(errors, F.lit(5)))).cast("int")))


def evidence_allowances(lengths: Column, budget: int) -> Column:
    """Characters that each text may take of a budget: what is left over the texts that are left, in order; what one doesn't need goes to the next."""
    n = F.size(lengths)
    start = F.struct(F.lit(budget).alias("left"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        share = F.floor(F.greatest(s["left"], F.lit(0)) / (n - F.size(s["out"]))).cast("int")
        take = F.least(x.cast("int"), share)
        return F.struct((s["left"] - take).alias("left"), F.concat(s["out"], F.array(take)).alias("out"))

    return F.aggregate(lengths, start, step, lambda s: s["out"])
