"""Source ingest: chunks in order, each new, a duplicate of what was there or came before it, or skipped.

A chunk is a duplicate if a memory of the store, or an earlier chunk that was new, is at least as similar as a threshold. So
what a chunk becomes hangs on the chunks before it. The first chunks that are still open, a block of them, are settled in order by one
task; the new ones among them are then held against all later chunks where those lie, from files, as the store is, and the next
block follows. So no pair is written down but a chunk's best match of a round, and no task gets more than a block however many
chunks are alike. Products are taken in single precision, and once more in double for the rows that may have a match.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallbase.operators.shared import cut
from recallbase.operators.vectors import STRETCH, by_dim, query_blocks, query_files

#: Open chunks that are settled in a round at least, and numbers in their vectors at most, where these are more chunks.
BLOCK, NUMBERS = 4096, 1 << 21
#: Rows that meet a file of vectors at once.
TILE = 512


def _units(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of equal dimension as rows of length one; zero vectors stay."""
    joined = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    v = joined.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(joined), -1)
    length = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, length, out=v.copy(), where=length > 0)


def _edge(least: float, dim: int) -> float:
    """What the product of two vectors of length one may be in single precision where it is `least` in double."""
    return least - (dim + 8) * 2.0**-23


def first_of_each(v: np.ndarray, least: float, tile: int = 1024) -> np.ndarray:
    """Places of the rows of length one or zero that no earlier row among them is as similar to as `least`, in order; a tile of rows at a time."""
    single, edge = v.astype(np.float32), _edge(least, v.shape[1])
    taken, n = np.zeros(len(v), np.int64), 0
    for a in range(0, len(v), tile):
        part = np.arange(a, min(a + tile, len(v)))
        for b in range(0, n, BLOCK):
            earlier = taken[b : min(b + BLOCK, n)]
            may = (single[part] @ single[earlier].T).max(1) >= edge
            if may.any():
                may[may] = np.round(v[part[may]] @ v[earlier].T, 9).max(1) >= least
                part = part[~may]
        near, gone = np.round(v[part] @ v[part].T, 9) >= least, np.zeros(len(part), bool)
        for i in range(len(part)):
            if not gone[i]:
                taken[n] = part[i]
                n += 1
                gone |= near[i]
    return taken[:n]


def _matches(rows: DataFrame, folder: str, least: float) -> DataFrame:
    """pos, similarity, match of the rows (pos, vector) that are near a vector of the files (query_id, vector, place) with a smaller place: the most similar one, the smallest id of equals."""

    def answers(part: pa.Table) -> pa.RecordBatch:
        pos = part["pos"].to_numpy()
        top, who = np.full(len(pos), -2.0), np.zeros(len(pos), np.int64)
        own = {}
        for at, v, length in by_dim(part["vector"]):
            fine = np.isfinite(length)
            unit = v[fine] / length[fine, None]
            own[v.shape[1]] = at[fine], unit, unit.astype(np.float32)
        for block in query_blocks(folder):
            ids, places = block["query_id"].to_numpy(), block["place"].to_numpy()
            for there, w, length in by_dim(block["vector"]):
                if w.shape[1] not in own:
                    continue
                there, w = there[np.isfinite(length)], w[np.isfinite(length)] / length[np.isfinite(length), None]
                order = np.argsort(ids[there], kind="stable")  # by id, so that the first of equals is the one to keep
                there, w = there[order], w[order]
                if not len(there):
                    continue
                single, edge = w.astype(np.float32), _edge(least, w.shape[1])
                at, v, v_single = own[w.shape[1]]
                for a in range(0, len(at), TILE):
                    may = a + np.flatnonzero((v_single[a : a + TILE] @ single.T).max(1) >= edge)
                    if not len(may):
                        continue
                    sims = np.round(v[may] @ w.T, 9)
                    sims[places[there][None, :] >= pos[at[may], None]] = -2.0
                    best = sims.argmax(1)
                    sim, match = sims[np.arange(len(may)), best], ids[there[best]]
                    row = at[may]
                    better = (sim > top[row]) | ((sim == top[row]) & (match < who[row]))
                    top[row[better]], who[row[better]] = sim[better], match[better]
        hit = top >= least
        return pa.RecordBatch.from_arrays([pa.array(pos[hit]), pa.array(top[hit]), pa.array(who[hit])], names=["pos", "similarity", "match"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= STRETCH:
                yield answers(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield answers(pa.Table.from_batches(held))

    return rows.select("pos", "vector").mapInArrow(work, "pos long, similarity double, match long")


def _settle(rows: DataFrame, open_rows: DataFrame, least: float, block: int) -> tuple[DataFrame, DataFrame] | None:
    """(new, hits): the new chunks (pos, id) among the first open ones, and for later chunks that are near one (pos, similarity, match). None if none is open."""
    first = cut(rows.join(F.broadcast(open_rows.orderBy("pos").limit(block)), "pos"), 0)
    if first.isEmpty():
        return None

    def choose(part: pa.Table) -> pa.Table:
        part = part.sort_by("pos")
        return part.take(pa.array(first_of_each(_units(part["vector"]), least)))

    new = cut(first.groupBy().applyInArrow(choose, first.schema), 0)  # a block at most
    folder = query_files(new.select(F.col("id").alias("query_id"), "vector", F.col("pos").alias("place")), "place")
    later = rows.where(F.col("pos") > new.agg(F.min("pos")).first()[0])
    return new.select("pos", "id"), cut(_matches(later, folder, least))


def ingest(chunks: DataFrame, store: DataFrame, least: float = 0.93, block: int | None = None) -> DataFrame:
    """pos, id, outcome (new, duplicate, skipped), match, similarity, corroborated of chunks (pos, id, vector, source, allowed) in order of pos, which is unique, against a store (id, vector, source).

    match is the most similar of the store's memories and the earlier new chunks, the smaller id of equals. It is
    corroborated when its own source is another one and this is the first chunk of that source to match it. Chunks that aren't
    allowed, or without a vector, are skipped and matched by nobody. All vectors are of one dimension; zero vectors are near nothing.
    """
    fine = F.coalesce("allowed", F.lit(False)) & F.col("vector").isNotNull()
    rows = cut(chunks.where(fine).select(F.col("pos").cast("long").alias("pos"), F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"), "source").repartition(2 * chunks.sparkSession.sparkContext.defaultParallelism, "pos"))  # every row is long work
    folder = query_files(store.select(F.col("id").alias("query_id"), "vector", F.lit(-(2**63)).cast("long").alias("place")), "place")
    hits = [cut(_matches(rows, folder, least))]
    open_rows, new = cut(rows.select("pos").join(hits[0], "pos", "left_anti")), []
    vectors = rows.select("pos", "id", "vector")
    if block is None:
        one = rows.select(F.size("vector")).first()
        block = max(BLOCK, NUMBERS // max(1, one[0])) if one else BLOCK
    while settled := _settle(vectors, open_rows, least, block):
        new.append(settled[0])
        hits.append(settled[1])
        open_rows = cut(open_rows.join(settled[0].unionByName(settled[1].select("pos", F.lit(None).cast("long").alias("id"))).select("pos").distinct(), "pos", "left_anti"))
    best = reduce(DataFrame.unionByName, hits).groupBy("pos").agg(F.min_by(F.struct("match", "similarity"), F.struct(-F.col("similarity"), "match")).alias("b")).select("pos", "b.match", "b.similarity")
    fresh = reduce(DataFrame.unionByName, new) if new else rows.select("pos", "id").limit(0)
    told = rows.select("pos", "id", "source").join(best, "pos", "left").join(fresh.select("pos", F.lit(True).alias("_new")), "pos", "left")
    told = cut(told.withColumn("match", F.when(F.col("_new").isNull(), F.col("match"))).withColumn("similarity", F.when(F.col("_new").isNull(), F.col("similarity"))))
    own = store.select(F.col("id").cast("long").alias("match"), F.col("source").alias("_own")).unionByName(told.where("_new").select(F.col("id").alias("match"), F.col("source").alias("_own")))
    firsts = told.where("match is not null").groupBy("match", "source").agg(F.min("pos").alias("pos")).join(own, "match").where(~F.col("source").eqNullSafe(F.col("_own"))).select("pos").distinct().withColumn("_first", F.lit(True))
    done = told.join(firsts, "pos", "left").select("pos", "id", F.when(F.col("_new"), "new").otherwise("duplicate").alias("outcome"), "match", "similarity", F.coalesce("_first", F.lit(False)).alias("corroborated"))
    none = lambda kind: F.lit(None).cast(kind)
    return done.unionByName(chunks.where(~fine).select(F.col("pos").cast("long").alias("pos"), F.col("id").cast("long").alias("id"), F.lit("skipped").alias("outcome"), none("long").alias("match"), none("double").alias("similarity"), F.lit(False).alias("corroborated")))
