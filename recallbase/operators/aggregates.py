"""Summaries, facets, histograms, costs and run statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallbase.operators.shared import small

#: Upper bounds in seconds of the request histogram.
DURATIONS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)


def counts_by(rows: DataFrame, *dimensions: str) -> DataFrame:
    """(dimension, value, n) for several columns in one pass, by grouping sets. Null values are counted as such."""
    texts = [F.col(d).cast("string").alias(d) for d in dimensions]
    sets = [[F.col(d)] for d in dimensions]
    grouped = rows.select(*texts).groupingSets(sets, *[F.col(d) for d in dimensions]).agg(F.count("*").alias("n"), *[F.grouping(d).alias(f"_{d}") for d in dimensions])
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d in dimensions:
        name, value = F.when(F.col(f"_{d}") == 0, F.lit(d)).otherwise(name), F.when(F.col(f"_{d}") == 0, F.col(d)).otherwise(value)
    return grouped.select(name.alias("dimension"), value.alias("value"), "n")


def facets(parts: Sequence[tuple[str, DataFrame]], limit: int = 8) -> DataFrame:
    """(facet, name, n, rank) of the most frequent names of each facet; parts are (facet, rows with a column name). Ties by lower-cased name, then name. limit is held within 1 to 30."""
    limit = min(30, max(1, limit))
    rows = None
    for facet, names in parts:
        part = names.select(F.lit(facet).alias("facet"), F.trim("name").alias("name")).where("name <> ''")
        rows = part if rows is None else rows.unionByName(part)
    counted = rows.groupBy("facet", "name").agg(F.count("*").alias("n"))
    best = Window.partitionBy("facet").orderBy(F.desc("n"), F.lower("name"), "name")
    return counted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def http_histogram(requests: DataFrame, *keys: str) -> DataFrame:
    """requests, errors (code 400 or more), bytes, avg_ms and p95_ms (a bucket's bound) per key."""
    from recallbase.functions.exprs import histogram_p95

    buckets = [F.count_if(F.col("seconds") <= b).alias(f"_b{i}") for i, b in enumerate(DURATIONS)]
    g = requests.groupBy(*keys).agg(F.count("*").alias("requests"), F.count_if(F.col("code") >= 400).alias("errors"), F.sum("bytes").alias("bytes"), (F.avg("seconds") * 1000).alias("avg_ms"), *buckets)
    return g.select(*keys, "requests", "errors", "bytes", "avg_ms", histogram_p95(F.col("requests"), [(b, F.col(f"_b{i}")) for i, b in enumerate(DURATIONS)]).alias("p95_ms"))


def run_stats(events: DataFrame) -> DataFrame:
    """Counters of each research run by event type, its last sequence number and the sequence number of its last error."""
    t = F.col("type")
    n = lambda cond, name: F.count_if(cond).alias(name)
    failed = (F.col("status") == "error") | t.endswith(".error")
    return events.groupBy("run_id").agg(
        n(t == "search.result", "results"), n(t == "download.started", "downloads_started"), n(t == "download.completed", "downloads_completed"), n(t == "claim.extracted", "claims"), n(t == "evidence.learned", "new_evidence"),
        n(t.isin("evidence.duplicate", "source.duplicate", "evidence.corroborated"), "duplicates"), n(t == "evidence.corroborated", "corroborations"), n(t == "source.rejected", "rejected_sources"), n(t == "evidence.skipped", "skipped_evidence"),
        n(failed, "errors"), F.max("seq").alias("last_seq"), F.max(F.when(failed, F.col("seq"))).alias("last_error_seq"), F.max("created_at").alias("updated_at"),
    )


def cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage with its cost by the price of its model: embeddings by input, else uncached, cached and output tokens at their rates, the long-context ones beyond the threshold.

    prices: model, input, cached, output, embedding, long_from, long_input, long_cached, long_output (per million; 0 is unset). Models without a price are left out.
    """
    p = usage.join(small(prices), "model")
    long = (F.col("long_from") > 0) & (F.col("input_tokens") > F.col("long_from"))
    rate = lambda name: F.when(long & (F.col(f"long_{name}") > 0), F.col(f"long_{name}")).otherwise(F.col(name))
    cached = F.when(rate("cached") == 0, rate("input")).otherwise(rate("cached"))
    uncached = F.greatest(F.col("input_tokens") - F.col("cached_tokens"), F.lit(0))
    chat = uncached / 1e6 * rate("input") + F.col("cached_tokens") / 1e6 * cached + F.col("output_tokens") / 1e6 * rate("output")
    embed = F.col("input_tokens") / 1e6 * F.when(F.col("embedding") == 0, F.col("input")).otherwise(F.col("embedding"))
    return p.withColumn("cost", F.when(F.col("category") == "embedding", embed).otherwise(chat)).select(*usage.columns, "cost")


def usage_totals(costs: DataFrame, now: str) -> DataFrame:
    """Cost of the calendar day and the calendar month of the literal time `now`."""
    at = F.lit(now).cast("timestamp_ntz")
    same = lambda unit: F.sum(F.when(F.date_trunc(unit, F.col("created_at")) == F.date_trunc(unit, at), F.col("cost")).otherwise(0.0))
    return costs.agg(same("day").alias("daily"), same("month").alias("monthly"))


def nearest_rank(rows: DataFrame, key: str, value: str, **shares: float) -> DataFrame:
    """Percentiles per key that are values of the column: the one at rank ceil(share * n). Nulls don't count."""
    return rows.groupBy(key).agg(*[F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY `{value}`)").alias(name) for name, share in shares.items()])


def reciprocal_rank(ranked: DataFrame, k: int) -> DataFrame:
    """cases, recall_at_k, mrr over ranked (case_id, rank of the expected document, null if not found)."""
    hit = F.col("rank").isNotNull() & (F.col("rank") <= k)
    return ranked.agg(F.count("*").alias("cases"), F.avg(hit.cast("double")).alias("recall_at_k"), F.avg(F.when(hit, F.lit(1.0) / F.col("rank")).otherwise(0.0)).alias("mrr"))


def goal_evaluation(progress: Column, evidence: Column, sources: Column, corroborations: Column) -> Column:
    """How far a research goal got, from its progress and what it gathered."""
    sat = lambda v, target: F.least(F.lit(1.0), v.cast("double") / target)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.45 * progress + 0.25 * sat(evidence, 20) + 0.20 * sat(sources, 4) + 0.10 * sat(corroborations, 2)))


def goal_progress(evidence: Column, sources: Column, corroborations: Column, evaluation: Column) -> Column:
    """Progress of a goal without a numeric target."""
    sat = lambda v, target: F.least(F.lit(1.0), v.cast("double") / target)
    quality = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (evaluation + 1) / 2))
    return F.least(F.lit(1.0), 0.55 * sat(evidence, 20) + 0.25 * sat(sources, 8) + 0.15 * sat(corroborations, 5) + 0.05 * quality)


def reconciled_goals(goals: DataFrame, events: DataFrame) -> DataFrame:
    """goal_id, progress, changed of all goals (goal_id, progress): progress counted anew from the trace (goal_id, type, memory_id, source_id), in one job; a goal without evidence has that of none."""
    e = events.where(F.col("type").isin("evidence.learned", "evidence.corroborated"))
    g = e.groupBy("goal_id").agg(F.count_distinct("memory_id").alias("_e"), F.count_distinct("source_id").alias("_s"), F.count_distinct(F.when(F.col("type") == "evidence.corroborated", F.struct("memory_id", "source_id"))).alias("_c"))
    n = lambda c: F.coalesce(c, F.lit(0))
    new = goal_progress(n("_e"), n("_s"), n("_c"), F.lit(0.0))
    return goals.join(g, "goal_id", "left").select("goal_id", new.alias("progress"), (F.round(new, 9) != F.round("progress", 9)).alias("changed"))


def search_totals(queries: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """key, total, fallback of each query: how many hits (key, n) it has, and whether it has none, so that a model is asked instead."""
    total = F.coalesce("n", F.lit(0))
    return queries.join(hits, key, "left").select(key, total.alias("total"), (total == 0).alias("fallback"))
