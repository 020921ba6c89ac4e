"""Association graphs: degrees, components, bounded expansion, subgraphs, blast radius."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallbase.operators.shared import cut


def adjacency(edges: DataFrame, *also: str) -> DataFrame:
    """Each undirected edge (a, b) from both of its ends."""
    return edges.select("a", "b", *also).union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), *also))


def degrees(edges: DataFrame) -> DataFrame:
    return adjacency(edges).groupBy(F.col("a").alias("id")).agg(F.count_distinct("b").alias("degree"))


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(id, component) of every node in edges (a, b); component is the smallest id reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014). Each is a min per node, combined before the
    shuffle, and a join back, which AQE splits when a node is hot; nothing is gathered per node. Every round is cut by a
    checkpoint. Self loops keep lone nodes. Empty edges give no rows.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null").distinct())
    size = e.count()  # no round makes more edges than there were
    nodes = e.select(F.col("a").alias("id")).union(e.select("b")).distinct()
    e = e.where("a <> b")
    seen = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        e = cut(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct(), size)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        if state[0] == state[2] and not e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count():
            break
        if state == seen:
            raise RuntimeError("components did not settle")
        seen = state
    else:
        raise RuntimeError(f"components need more than {most_rounds} rounds")
    return nodes.join(e.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of every node: the least id it reaches; lone nodes are their own. Edges lie between nodes."""
    linked = components(edges.select("a", "b"))
    return nodes.select("id").distinct().join(linked, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, edges, isolated, linked, multi_linked, max_degree, avg_degree, components, largest."""
    d = nodes.select("id").join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    one = d.agg(F.count("*").alias("nodes"), F.count_if(F.col("degree") == 0).alias("isolated"), F.count_if(F.col("degree") > 0).alias("linked"), F.count_if(F.col("degree") > 1).alias("multi_linked"), F.max("degree").alias("max_degree"), F.avg("degree").alias("avg_degree"))
    sizes = connected(nodes, edges).groupBy("component").agg(F.count("*").alias("n")).agg(F.count("*").alias("components"), F.max("n").alias("largest"))
    return one.join(F.broadcast(sizes)).join(F.broadcast(edges.agg(F.count("*").alias("edges"))))  # a row each


def expand(seeds: DataFrame, edges: DataFrame, allowed: DataFrame, bonus: float, hops: int = 2, decay: float = 0.6, least_weight: float = 0.0) -> DataFrame:
    """(query_id, id, boost) reached from seeds (query_id, id): a hop multiplies by the edge's weight, from the second on also by decay; the best path counts.

    A hop is one join and one max per (query, node). Seeds start without a boost and may get one. allowed (id) limits the nodes.
    """
    if not 1 <= hops <= 6:
        raise ValueError("1 to 6 hops")
    strong = adjacency(edges.where(F.col("weight") >= least_weight), "weight").join(allowed.select(F.col("id").alias("b")), "b", "left_semi")
    front = seeds.select("query_id", F.col("id").alias("a"), F.lit(bonus).alias("boost"))
    best = None
    for hop in range(hops):
        step = F.col("boost") * F.col("weight") * (decay if hop else 1.0)
        reached = front.join(strong, "a").groupBy("query_id", F.col("b").alias("id")).agg(F.max(step).alias("boost"))
        best = reached if best is None else best.unionByName(reached).groupBy("query_id", "id").agg(F.max("boost").alias("boost"))
        front = reached.withColumnRenamed("id", "a")
    return best


def reachable(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(id, depth) of the nodes within `depth` undirected steps of seeds (id), seeds at 0."""
    both = adjacency(edges).distinct()
    seen = seeds.select("id", F.lit(0).alias("depth")).distinct()
    front = seen
    for d in range(1, depth + 1):
        front = cut(front.join(both, front.id == both.a).select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(front)
    return seen


def subgraph(nodes: DataFrame, edges: DataFrame, priority: Column, most_nodes: int, most_edges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The nodes of the highest priority (ties: least id) and the heaviest edges among them."""
    kept = nodes.select("*", priority.alias("priority")).orderBy(F.desc("priority"), "id").limit(most_nodes)
    ids = kept.select("id")
    inside = edges.join(F.broadcast(ids.select(F.col("id").alias("a"))), "a", "left_semi").join(F.broadcast(ids.select(F.col("id").alias("b"))), "b", "left_semi")
    return kept, inside.orderBy(F.desc("weight"), "a", "b").limit(most_edges or 4 * most_nodes)


def lineage(parts: list[tuple[DataFrame, DataFrame | None]]) -> tuple[DataFrame, DataFrame]:
    """Unions nodes (id, kind, label) and edges (from, to, kind) of several projections, each node and edge once; the first label in order wins."""
    nodes, edges = None, None
    for n, e in parts:
        nodes = n if nodes is None else nodes.unionByName(n)
        if e is not None:
            edges = e if edges is None else edges.unionByName(e)
    return nodes.groupBy("id").agg(F.min(F.struct("kind", "label")).alias("m")).select("id", "m.kind", "m.label"), edges.distinct()


def top_edges(edges: DataFrame, per_node: int) -> DataFrame:
    """The heaviest edges of every node, from its own end."""
    w = Window.partitionBy("a").orderBy(F.desc("weight"), "b")
    return adjacency(edges, "weight").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_node)


def memory_graph(memories: DataFrame, synapses: DataFrame, most: int = 320) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a display graph without texts or vectors: the `most` memories of highest priority and what links them.

    memories: id, memory_type, status, priority, created_at, supersedes and consolidated_from (arrays of ids, perhaps null);
    the later created of equal priority comes first, then the smaller id. Edges lie between kept nodes alone: synapses (a, b,
    weight), a memory to those that it supersedes, and those that were consolidated to the one they went into.
    """
    if not 1 <= most <= 10_000:
        raise ValueError("1 to 10000 nodes")
    kept = cut(memories.orderBy(F.desc("priority"), F.desc("created_at"), "id").limit(most), 0)
    ids = F.broadcast(kept.select("id"))  # `most` rows
    both = lambda rows: rows.join(ids.withColumnRenamed("id", "from"), "from", "left_semi").join(ids.withColumnRenamed("id", "to"), "to", "left_semi")
    linked = both(synapses.select(F.col("a").alias("from"), F.col("b").alias("to"), F.lit("synapse").alias("kind"), F.col("weight").cast("double").alias("weight")))
    newer = both(kept.select(F.col("id").alias("from"), F.explode("supersedes").alias("to"), F.lit("supersedes").alias("kind"), F.lit(1.0).alias("weight")))
    merged = both(kept.select(F.explode("consolidated_from").alias("from"), F.col("id").alias("to"), F.lit("consolidated_into").alias("kind"), F.lit(1.0).alias("weight")))
    nodes = kept.select("id", F.concat(F.lit("memory_"), "memory_type").alias("kind"), F.coalesce("status", F.lit("active")).alias("status"), "priority")
    return nodes, linked.unionByName(newer).unionByName(merged).select("from", "to", "kind", "weight")


def learning_lineage(outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of outcomes (id, ticket_id, decision, supersedes, memory_id): a ticket to its outcomes, an outcome to the one it replaces, if that is there, and to the memory it was learned as."""
    ticket, own = F.concat(F.lit("ticket:"), F.col("ticket_id").cast("string")), F.concat(F.lit("outcome:"), F.col("id").cast("string"))
    replaced = outcomes.join(outcomes.select(F.col("id").alias("supersedes")), "supersedes", "left_semi")
    learned = outcomes.where("memory_id is not null")
    memory = F.concat(F.lit("memory:"), F.col("memory_id").cast("string"))
    node = lambda rows, key, kind, label: rows.select(key.alias("id"), F.lit(kind).alias("kind"), label.alias("label"))
    edge = lambda rows, a, b, kind: rows.select(a.alias("from"), b.alias("to"), F.lit(kind).alias("kind"))
    return lineage([
        (node(outcomes, ticket, "ticket", F.concat(F.lit("Ticket #"), F.col("ticket_id").cast("string"))), edge(outcomes, ticket, own, "has_outcome")),
        (node(outcomes, own, "outcome", F.col("decision")), edge(replaced, own, F.concat(F.lit("outcome:"), F.col("supersedes").cast("string")), "supersedes")),
        (node(learned, memory, "memory", memory), edge(learned, own, memory, "learned_as")),
    ])


def topology(services: DataFrame, links: DataFrame, checks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of services (id, kind) and their links (from, to, kind): a service is online or has a problem by its latest check (id, at, ok, latency), and is configured where there is none. Links to unknown services are left out."""
    last = checks.groupBy("id").agg(F.max_by(F.struct("ok", "latency"), F.struct("at", "ok")).alias("c"))
    state = F.when(F.col("c").isNull(), "configured").when(F.col("c.ok"), "online").otherwise("problem")
    nodes = services.join(last, "id", "left").select("id", "kind", state.alias("status"), F.col("c.latency").alias("latency"))
    ids = services.select("id")
    known = links.join(ids.withColumnRenamed("id", "from"), "from", "left_semi").join(ids.withColumnRenamed("id", "to"), "to", "left_semi")
    return nodes, known.select(F.concat("from", F.lit("->"), "to", F.lit(":"), "kind").alias("id"), "from", "to", "kind")
