"""Memories through their life: insertion, conflicts, corroboration, reinforcement, decay, retention, consolidation. Each is (old, events, now) -> new."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallbase.functions import exprs as X
from recallbase.operators.graph import components
from recallbase.operators.shared import cut, first_rows, small


def with_defaults(new: DataFrame) -> DataFrame:
    """New memories with the defaults: salience and confidence 1, type by kind, status active, version 1."""
    return (
        new.withColumn("salience", F.when(F.coalesce("salience", F.lit(0.0)) == 0, 1.0).otherwise(F.col("salience"))).withColumn("confidence", F.when(F.coalesce("confidence", F.lit(0.0)) == 0, 1.0).otherwise(F.col("confidence")))
        .withColumn("memory_type", F.when(F.coalesce("memory_type", F.lit("")) == "", X.memory_type_of(F.col("kind"))).otherwise(F.col("memory_type"))).withColumn("status", F.when(F.coalesce("status", F.lit("")) == "", "active").otherwise(F.col("status")))
        .withColumn("version", F.when(F.coalesce("version", F.lit(0)) == 0, 1).otherwise(F.col("version")))
    )


def insert(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and those of new whose id isn't there yet; of new rows with one id, any one."""
    fresh = new.dropDuplicates(["id"]).join(old.select("id"), "id", "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def delete(memories: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without these ids and the edges at them."""
    gone = ids.select("id").distinct()
    return memories.join(gone, "id", "left_anti"), edges.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti")


def conflict_outcome(new_version: Column, old_version: Column, new_text: Column, old_text: Column, new_score: Column, old_score: Column) -> Column:
    """What becomes of a new memory and an old one on the same truth key: `new_supersedes`, `old_supersedes` or `conflict`."""
    same = F.lower(F.trim(new_text)) == F.lower(F.trim(old_text))
    return (
        F.when(same, F.when(new_version >= old_version, "new_supersedes").otherwise("old_supersedes")).when(new_version > old_version, "new_supersedes").when(old_version > new_version, "old_supersedes")
        .when(F.abs(new_score - old_score) < 0.15, "conflict").when(new_score > old_score, "new_supersedes").otherwise("old_supersedes")
    )


#: Nodes of a component that is finished in the plain order, and links for each node of it; rounds before components are looked for again.
MATES, MATE_LINKS, ROUNDS = 2_000, 20, 3
#: Scores are compared in billionths, a gap of this many or more decides. Scores that a window takes together.
GAP, RANGE = 150_000_000, 1_000_000


def at_least(points: DataFrame, keys: list[str], asked: DataFrame, first: Column, fold: Callable[[str], Column]) -> DataFrame:
    """*keys, at, found: for every (keys, at) that is asked for, the fold over the points (keys, score) of the same keys with a score of at least `at`.

    `first` folds points, `fold` folds what came of that; both must be free in their order. Points are folded by score before
    anything else, then within ranges of RANGE scores, then over ranges. So a window holds a range's scores or a key's
    ranges, never a key's points.
    """
    once = points.groupBy(*keys, F.col("score").alias("at")).agg(first.alias("v"))
    both = cut(once.withColumn("_ask", F.lit(0)).unionByName(asked.select(*keys, "at").distinct().withColumn("_ask", F.lit(1)), allowMissingColumns=True).withColumn("_range", F.floor(F.col("at") / RANGE)))
    above = both.groupBy(*keys, "_range").agg(fold("v").alias("v")).withColumn("_above", fold("v").over(Window.partitionBy(*keys).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1))).drop("v")
    inside = both.withColumn("_in", fold("v").over(Window.partitionBy(*keys, "_range").orderBy(F.desc("at"), "_ask").rowsBetween(Window.unboundedPreceding, 0))).where("_ask = 1")
    met = inside.join(above, [*keys, "_range"])
    ends = met.select(*keys, "at", F.explode(F.array("_in", "_above")).alias("v"))
    return cut(ends.groupBy(*keys, "at").agg(fold("v").alias("found")))


def resolve_conflicts(memories: DataFrame) -> DataFrame:
    """id, new_status, conflict_group as if all memories of each truth key were added in order of version, time and id, each met by all before it.

    A row that meets a newer version is superseded, whatever came before, so only a key's newest version needs a look. There
    the last later row of the same text, or of a score that isn't 0.15 lower, decides a row's status; that row comes from
    maxima over texts and over ranges of scores, so a key that holds most rows is spread over tasks. A row without such a later one is decided by the rows before it; each of these
    rows scores 0.15 less than the one before, so a key has a handful. Archived rows keep their status and are met by nobody.
    Rows without a key are left out.
    """
    score = X.knowledge_score(F.col("confidence"), F.col("reward"), F.col("salience"))
    rows = memories.select("id", F.lower(F.trim("truth_key")).alias("key"), "version", "created_at", "status", F.sha2(F.lower(F.trim("text")), 256).alias("text_hash"), F.round(score * 1e9).cast("long").alias("score")).where("key <> ''")
    live = cut(rows.where("status <> 'archived'"))
    live = live.join(live.groupBy("key").agg(F.max("version").alias("newest")), "key")
    top = cut(live.where("version = newest").withColumn("n", F.struct("created_at", "id")).select("id", "key", "n", "text_hash", "score", "status"))
    points = top.select("key", "text_hash", "score", F.struct("n", "text_hash", "score").alias("me"))
    by_score = at_least(points, ["key"], points.select("key", (F.col("score") + 1 - GAP).alias("at")), F.max("me"), F.max)
    by_text = points.groupBy("key", "text_hash").agg(F.max("me").alias("last_text"))
    near = {}
    for name, keys in (("near", ["key"]), ("alike", ["key", "text_hash"])):
        ends = points.select(*keys, (F.col("score") + 1 - GAP).alias("at")).unionByName(points.select(*keys, (F.col("score") + GAP).alias("at")))
        near[name] = (keys, at_least(points, keys, ends, F.count("*"), F.sum))
    top = top.withColumn("at", F.col("score") + 1 - GAP).join(by_score.withColumnRenamed("found", "last_score"), ["key", "at"], "left").join(by_text, ["key", "text_hash"], "left")
    for name, (keys, counts) in near.items():
        for side, at in (("_from", F.col("score") + 1 - GAP), ("_upto", F.col("score") + GAP)):
            top = top.withColumn("at", at).join(counts.withColumnRenamed("found", name + side), [*keys, "at"], "left")
    within = lambda name: F.coalesce(name + "_from", F.lit(0)) - F.coalesce(name + "_upto", F.lit(0))
    top = cut(top.select("id", "key", "n", "text_hash", "score", "status", F.greatest("last_score", "last_text").alias("last"), (within("near") > within("alike")).alias("contested")))
    by_later = F.when((F.col("last.text_hash") == F.col("text_hash")) | (F.col("last.score") - F.col("score") >= GAP), "superseded").otherwise("conflicted")
    survivors = top.where("last.n = n").select("id", "key", "n", "text_hash", "score")
    before = top.select("key", F.col("n").alias("n_j"), F.col("text_hash").alias("text_j"), F.col("score").alias("score_j"))
    met = before.join(small(survivors), "key").where((F.col("n_j") < F.col("n")) & (F.col("text_j") != F.col("text_hash")) & (F.col("score") - F.col("score_j") < GAP))
    by_before = met.groupBy("id").agg(F.max_by(F.when(F.col("score") - F.col("score_j") > -GAP, "conflicted").otherwise("superseded"), F.col("n_j")).alias("by_before"))
    decided = top.join(by_before, "id", "left").select(
        "id", F.when(F.col("last.n") > F.col("n"), by_later).otherwise(F.coalesce("by_before", "status")).alias("new_status"), F.when(F.col("contested"), F.concat(F.lit("conflict:"), "key")).alias("conflict_group"),
    )
    plain = lambda df, status: df.select("id", status.alias("new_status"), F.lit(None).cast("string").alias("conflict_group"))
    return decided.unionByName(plain(live.where("version < newest"), F.lit("superseded"))).unionByName(plain(rows.where("status = 'archived'"), F.col("status")))


def resolve_manually(memories: DataFrame, key: str, winner: int) -> DataFrame:
    """The winner active, all others of the key superseded, the conflict cleared."""
    mine = F.lower(F.trim("truth_key")) == key.strip().lower()
    return memories.withColumn("status", F.when(mine, F.when(F.col("id") == winner, "active").otherwise("superseded")).otherwise(F.col("status")))


def corroborate(memories: DataFrame, evidence: DataFrame) -> DataFrame:
    """confidence and salience after distinct sources (id, source_id, weight) spoke for a memory: 1 - (1 - c) * prod(1 - .35 w), and .04 w of salience each, 2.5 at most.

    The product is taken as a sum of logarithms, so the order is free; a source counts once, with its largest weight.
    """
    once = evidence.groupBy("id", "source_id").agg(F.max("weight").alias("w"))
    total = once.groupBy("id").agg(F.exp(F.sum(F.log(1 - 0.35 * F.col("w")))).alias("left"), F.sum("w").alias("w"), F.count("*").alias("sources"))
    j = memories.join(total, "id", "left")
    return j.withColumn("confidence", F.when(F.col("left").isNull(), F.col("confidence")).otherwise(1 - (1 - F.col("confidence")) * F.col("left"))).withColumn("salience", F.least(F.lit(2.5), F.col("salience") + 0.04 * F.coalesce("w", F.lit(0.0)))).withColumn("sources", F.coalesce("sources", F.lit(0))).drop("left", "w")


def reinforce(events: DataFrame, daily_decay: float, most: float) -> DataFrame:
    """a, b, weight, activations of edges after their events (a, b, at_day, delta) in order of day and delta: decay since the last day, add, clamp.

    Clamping makes the order matter. Within a day what is taken away comes first and what is added last, so two sums stand for
    a day's events, however many; the fold over an edge's days is what is left.
    """
    lost, won = F.sum(F.least(F.col("delta"), F.lit(0.0))), F.sum(F.greatest(F.col("delta"), F.lit(0.0)))
    days = events.groupBy("a", "b", "at_day").agg(lost.alias("lost"), won.alias("won"), F.count("*").alias("n"))
    ordered = days.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("at_day", "lost", "won"))).alias("e"), F.sum("n").alias("activations"))
    keep = max(0.0, 1.0 - daily_decay)
    start = F.struct(F.lit(0.0).alias("w"), F.col("e")[0]["at_day"].cast("double").alias("d"))
    step = lambda s, x: F.struct(F.least(F.lit(most), F.greatest(F.lit(-most), s["w"] * F.pow(F.lit(keep), x["at_day"] - s["d"]) + x["lost"]) + x["won"]).alias("w"), x["at_day"].cast("double").alias("d"))
    return ordered.select("a", "b", F.aggregate("e", start, step)["w"].alias("weight"), "activations")


def edge_evidence(events: DataFrame, most: float) -> DataFrame:
    """a, b, weight, similarity, relations, activations of edges from evidence (a, b, relation, similarity, weight): replaying it changes nothing."""
    a, b = X.edge_ends(F.col("a"), F.col("b"))
    g = events.groupBy(a.alias("a"), b.alias("b")).agg(F.least(F.lit(most), F.max("weight")).alias("weight"), F.max("similarity").alias("similarity"), F.array_sort(F.collect_set("relation")).alias("relations"))
    return g.withColumn("activations", F.size("relations"))


def decay_edges(edges: DataFrame, days: Column, rate: float, prune: float) -> DataFrame:
    """Edges with decayed weights, without those whose weight fell below `prune`."""
    return edges.withColumn("weight", X.decayed(F.col("weight"), rate, days)).where(F.abs("weight") >= prune)


def touch(memories: DataFrame, touches: DataFrame, now: Column) -> DataFrame:
    """accessed_at and access_count after touches (id, repeats allowed)."""
    n = touches.groupBy("id").agg(F.count("*").alias("_n"))
    return memories.join(n, "id", "left").withColumn("access_count", F.col("access_count") + F.coalesce("_n", F.lit(0))).withColumn("accessed_at", F.when(F.col("_n").isNotNull(), now).otherwise(F.col("accessed_at"))).drop("_n")


def retention(memories: DataFrame, now: str, ttl_hours: float, least_age_days: float, least_utility: float, most: int) -> DataFrame:
    """id, action (`delete_ttl`, `archive`, `delete_cap`, `keep`), utility: expired working memories go, old useless ones are archived, then the least useful that aren't procedural go until `most` are left.

    The cap is found by counts over ranges of utility, so no task sorts all rows.
    """
    age = X.age_days(F.col("created_at"), now)
    utility = X.memory_utility(age, F.col("access_count"), F.col("salience"), F.col("confidence"), F.col("reward"))
    rows = memories.select("id", "memory_type", "status", age.alias("age"), utility.alias("utility"))
    ttl = (F.col("memory_type") == "working") & (F.col("age") * 24 >= ttl_hours)
    archive = (F.col("age") >= least_age_days) & (F.col("utility") < least_utility) & (F.col("status") != "archived")
    staged = cut(rows.withColumn("action", F.when(ttl, "delete_ttl").when(archive, "archive").otherwise("keep")))  # each round reads it
    left = staged.where("action <> 'delete_ttl'")
    need = max(0, left.count() - most)
    drop = first_rows(left.where("memory_type <> 'procedural'"), need, "utility", "id").select(F.col("id").alias("_id"))
    return staged.join(drop, F.col("id") == F.col("_id"), "left").select("id", F.when(F.col("_id").isNotNull(), "delete_cap").otherwise(F.col("action")).alias("action"), "utility")


def tiering(memories: DataFrame, budget: int, age_days: Column, most_days: float) -> DataFrame:
    """id, cold: bodies that are too old, or beyond the byte budget counted from the latest access; found by sums over ranges of time, so no task gets a day or more of them."""
    rows = cut(memories.select("id", "bytes", (age_days > most_days).alias("old"), (-F.unix_micros(F.col("accessed_at").cast("timestamp"))).alias("_at")))  # each round reads it
    hot = first_rows(rows, budget, "_at", "id", "bytes").select("id", F.lit(True).alias("_hot"))
    return rows.join(hot, "id", "left").select("id", (F.col("old") | F.col("_hot").isNull()).alias("cold"))


def revision_chain(outcomes: DataFrame) -> DataFrame:
    """id, run_id, supersedes of outcomes (id, run_id, at, decision): a repeat of the decision before it is dropped, others supersede the one kept before."""
    w = Window.partitionBy("run_id").orderBy("at", "id")
    kept = outcomes.withColumn("_before", F.lag("decision").over(w)).where(~F.col("decision").eqNullSafe(F.col("_before")) | F.col("_before").isNull())
    return kept.withColumn("supersedes", F.lag("id").over(w)).drop("_before")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key over both tables; new ones win ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    fields = [c for c in both.columns if c != "_new"]
    return both.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*fields), F.struct(order, "_new")).alias("r")).select("r.*")


def fold_log(log: DataFrame, key: str, revision: str, deleted: str, after: Column | None = None) -> DataFrame:
    """Latest record of each key in an append-only log, without deleted ones; `after` keeps records newer than a checkpoint."""
    rows = log if after is None else log.where(F.col(revision) > after)
    latest = rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*log.columns), F.col(revision)).alias("r")).select("r.*")
    return latest.where(~F.col(deleted))


def _in_order(nodes: DataFrame, links: DataFrame, least: int, most: int) -> DataFrame:
    """(cluster, id) by the plain loop over nodes (bundle, id, rank, tried) and links (bundle, a, b, similarity), each bundle for itself."""

    def loop(nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list] = {}
        for a, b, s in zip(links["a"].tolist(), links["b"].tolist(), links["similarity"].tolist(), strict=True):
            near.setdefault(a, []).append((-s, b))
        there, used, made = set(nodes["id"].tolist()), set(), []
        for seed in nodes[~nodes["tried"]].sort_values(["uses", "created_at", "id"])["id"].tolist():
            if seed in used:
                continue
            free = [b for _, b in sorted(near.get(seed, [])) if b in there and b not in used]
            members = [seed, *free[: most - 1]]
            if len(members) >= least:
                used.update(members)
                made += [(seed, x) for x in members]
        return pd.DataFrame(made, columns=["cluster", "id"])

    kind = dict(nodes.dtypes)["id"]
    rows = nodes.select("bundle", "id", "tried", F.col("rank.uses").alias("uses"), F.col("rank.created_at").alias("created_at"))
    return rows.groupBy("bundle").cogroup(links.select("bundle", "a", "b", "similarity").groupBy("bundle")).applyInPandas(loop, f"cluster {kind}, id {kind}")


def _small_components(nodes: DataFrame, links: DataFrame, least: int, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cluster, id) of the components of MATES nodes or fewer; nodes and links of the others."""
    of = cut(nodes.join(components(links), "id", "left").select("id", F.coalesce("component", "id").alias("component")))
    sizes = of.groupBy("component").agg(F.count("*").alias("n")).join(links.join(of.select(F.col("id").alias("a"), "component"), "a").groupBy("component").agg(F.count("*").alias("links")), "component", "left")
    few = sizes.where((F.col("n") <= MATES) & (F.coalesce("links", F.lit(0)) <= MATES * MATE_LINKS))
    total = few.agg(F.sum("n")).first()[0] or 0
    bundled = of.join(few.select("component"), "component").select("id", F.pmod(F.xxhash64("component"), F.lit(max(1, -(-total // MATES)))).alias("bundle"))
    placed = cut(nodes.join(bundled, "id", "left"))
    met = cut(links.join(placed.select(F.col("id").alias("a"), "bundle"), "a"))
    done = cut(_in_order(placed.where("bundle is not null"), met.where("bundle is not null"), least, most))
    return done, placed.where("bundle is null").drop("bundle"), met.where("bundle is null").select("a", "b", "similarity")


def consolidate(memories: DataFrame, neighbours: DataFrame, least: int, most: int) -> DataFrame:
    """(cluster, id): seeds by access count, then age, then id; each takes its most similar unused neighbours (a, b, similarity) up to `most` in all; clusters under `least` are dropped and their members stay free.

    The greedy order only matters between seeds that are at most two links apart. So each round takes all seeds at once that
    come first among those, which gives the clusters of the plain order; a round is joins and minima, cut by a checkpoint.
    Clusters never cross components, so a component of MATES nodes or fewer is done with in the plain order instead, some of
    them together in a group of about MATES nodes. Larger ones take rounds, in which they fall apart, and are looked at again.
    """
    rank = F.struct((-F.col("access_count")).alias("uses"), "created_at", "id")
    nodes = cut(memories.select("id", rank.alias("rank")).dropDuplicates(["id"]).withColumn("tried", F.lit(False)))
    both = neighbours.select("a", "b", "similarity").union(neighbours.select("b", "a", "similarity")).where("a <> b").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    ids = nodes.select("id")
    links = cut(both.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi"))
    found: list[DataFrame] = []
    nodes = cut(nodes.join(links.select(F.col("a").alias("id")).distinct(), "id", "left_semi")) if least > 1 else nodes
    rounds = 0
    while nodes.where("not tried").limit(1).count():
        if rounds % ROUNDS == 0:
            done, nodes, links = _small_components(nodes, links, least, most)
            found.append(done)
            if nodes.isEmpty():
                break
        rounds += 1
        waiting = nodes.where("not tried").select("id", "rank")
        near = links.join(waiting.select(F.col("id").alias("b"), "rank"), "b").groupBy(F.col("a").alias("id")).agg(F.min("rank").alias("near"))
        first = nodes.join(near, "id", "left").select("id", F.least(F.when(~F.col("tried"), F.col("rank")), "near").alias("first"))
        second = links.join(first.select(F.col("id").alias("b"), "first"), "b").groupBy(F.col("a").alias("id")).agg(F.min("first").alias("second"))
        ready = waiting.join(first, "id").join(second, "id", "left").where((F.col("rank") == F.col("first")) & (F.col("second").isNull() | (F.col("rank") <= F.col("second")))).select("id")
        ready = cut(ready)
        taken = links.join(ready.withColumnRenamed("id", "a"), "a", "left_semi").join(nodes.select(F.col("id").alias("b")), "b", "left_semi")
        near_first = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
        taken = taken.withColumn("_n", F.row_number().over(near_first)).where(F.col("_n") < most).select(F.col("a").alias("cluster"), F.col("b").alias("id"))
        every = ready.select(F.col("id").alias("cluster"), "id").unionByName(taken)
        large = every.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("cluster")
        made = cut(every.join(large, "cluster", "left_semi"))
        found.append(made)
        left = nodes.join(made.select("id"), "id", "left_anti").join(ready.withColumn("_now", F.lit(True)), "id", "left")
        nodes = cut(left.select("id", "rank", (F.col("tried") | F.coalesce("_now", F.lit(False))).alias("tried")))
        links = cut(links.join(nodes.select(F.col("id").alias("a")), "a", "left_semi").join(nodes.select(F.col("id").alias("b")), "b", "left_semi"))
    return reduce(DataFrame.unionByName, found) if found else memories.select(F.col("id").alias("cluster"), "id").limit(0)
