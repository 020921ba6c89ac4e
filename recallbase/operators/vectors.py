"""Exact vector search: explainable scores, sources, shards, neighbours, centroids."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallbase.functions import exprs as X
from recallbase.operators.shared import cut, new_folder

#: Query vectors in a file, rows that they meet at once, and similarities that a task holds at once.
QUERY_BLOCK, STRETCH, CELLS = 4096, 65_536, 2_000_000


def _best(sim: np.ndarray, k: int, digits: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k largest finite values to so many digits, the first columns among equals.

    Only what comes within rounding of a row's k-th value is rounded and sorted.
    """
    if not sim.shape[1]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if sim.shape[1] <= k:
        return np.nonzero(np.isfinite(sim))
    edge = sim.max(1) if k == 1 else np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k]
    row, column = np.nonzero(sim >= np.where(np.isfinite(edge), edge - 10.0**-digits - 1e-12 * np.abs(edge), -np.finfo(np.float64).max)[:, None])
    near = np.round(sim[row, column], digits)
    order = np.lexsort((column, -near, row))
    order = order[np.isfinite(near[order])]
    row, column = row[order], column[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    row, column = row[first], column[first]
    order = np.lexsort((column, row))
    return row[order], column[order]


def query_files(queries: DataFrame, *extra: str, size: int | None = None) -> str:
    """A new folder with the stated queries (query_id, vector, *extra) in files of about `size`. Null vectors and such of zero length are left out."""
    folder = new_folder(queries.sparkSession, "queries")
    rows = cut(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"), *extra).where("query_id is not null and vector is not null"))
    files = max(1, -(-rows.count() // (size or QUERY_BLOCK)))
    rows.repartition(files, F.xxhash64("query_id")).sortWithinPartitions("query_id").write.parquet(folder)
    return folder


def query_blocks(folder: str) -> Iterator[pa.Table]:
    """The blocks of query_files, one at a time."""
    files, top = pafs.FileSystem.from_uri(folder)
    for name in sorted(f.path for f in files.get_file_info(pafs.FileSelector(top)) if f.base_name.endswith(".parquet")):
        with files.open_input_file(name) as stream:
            block = pq.ParquetFile(stream).read()
        if block.num_rows:
            yield block


def by_dim(lists: pa.ChunkedArray | pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, vectors, lengths) of the vectors of each dimension, without null ones and those of zero length."""
    joined = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = pc.fill_null(pc.list_value_length(joined), 0).to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == dim)
        v = joined.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
        length = np.sqrt((v * v).sum(1))
        fine = length > 0  # not of those with null components
        yield at[fine], v[fine], length[fine]


def scan_nearest(folder: str, base: DataFrame, k: int, least: float, exclude_self: bool, within: str | None, factors: tuple[str, ...], digits: int) -> DataFrame:
    """query_id, id, similarity, *factors, score of the k best rows in every stretch of STRETCH rows of base, where they lie, for each query of the files. score is the similarity times the factors."""
    extra = (within,) if within else ()

    def answers(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = rows["id"].to_numpy()
        weights = [rows[f].to_numpy() for f in factors]
        classes = np.array(rows[within].to_pylist(), object) if within else None
        own = {}
        for at, v, length in by_dim(rows["vector"]):
            order = np.argsort(ids[at], kind="stable")  # by id, so that the first of equals is the one to keep
            own[v.shape[1]] = at[order], v[order], length[order]
        for block in query_blocks(folder):
            names = block["query_id"].to_numpy()
            asked = np.array(block[within].to_pylist(), object) if within else None
            for place, q, q_len in by_dim(block["vector"]):
                if q.shape[1] not in own:
                    continue
                at, v, length = own[q.shape[1]]
                step = max(1, CELLS // max(1, len(v)))
                for a in range(0, len(q), step):
                    part = place[a : a + step]
                    sim = (q[a : a + step] @ v.T) / (q_len[a : a + step, None] * length[None, :])
                    score = sim
                    for w in weights:
                        score = score * w[at][None, :]
                    fine = sim >= least
                    score = np.where(fine & np.isfinite(score) if weights else fine, score, -np.inf)
                    if exclude_self:
                        score[names[part, None] == ids[at][None, :]] = -np.inf
                    if within:
                        score[asked[part, None] != classes[at][None, :]] = -np.inf
                    who, best = _best(score, k, digits)
                    yield pa.RecordBatch.from_arrays([pa.array(names[part][who]), pa.array(ids[at][best]), pa.array(sim[who, best]), *(pa.array(w[at][best]) for w in weights), pa.array(score[who, best])], names=["query_id", "id", "similarity", *factors, "score"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= STRETCH:
                yield from answers(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from answers(pa.Table.from_batches(held))

    rows = base.where("id is not null and vector is not null").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"), *[F.col(f).cast("double").alias(f) for f in factors], *extra)
    return rows.mapInArrow(work, ", ".join(["query_id long, id long, similarity double", *(f"{f} double" for f in factors), "score double"]))


def neighbours(queries: DataFrame, base: DataFrame, k: int, least: float = -1.0, exclude_self: bool = True, within: str | None = None) -> DataFrame:
    """query_id, id, similarity, rank: for each query (query_id, vector) its k nearest rows of base (id, vector) by cosine, at least `least`.

    Queries are a stated set. They are written to files of QUERY_BLOCK each, which every task reads one after the other against a
    stretch of its own rows, so rows of base don't move, no query passes the driver, and the plan is the same for any number of queries. A
    stretch keeps k candidates a query; a shuffle carries those alone. Ties, to 9 digits, go to the smaller id. `within` names a column of both sides that
    must agree. Null vectors and such of zero length or another dimension find nothing and aren't found.
    """
    folder = query_files(queries, *([within] if within else []))
    found = scan_nearest(folder, base, k, least, exclude_self, within, (), 9).drop("score")
    best = Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(queries: DataFrame, memories: DataFrame, k: int = 8, least: float = 0.35, allowed: Column | None = None) -> DataFrame:
    """Explainable search: query_id, id, similarity, the factors, score, rank, candidate_source, for searchable memories of the query's dimension.

    queries (query_id, vector) is a stated set, which meets the memories as in `neighbours`; `allowed` narrows the memories before the ranking. Ties, to 12 digits, go to the smaller id.
    """
    rows = memories.where(X.searchable(F.col("status")))
    if allowed is not None:
        rows = rows.where(allowed)
    rows = rows.select("id", "vector", (0.75 + 0.25 * F.col("salience")).alias("salience_factor"), X.type_weight(F.col("memory_type")).alias("type_weight"), (0.85 + 0.15 * X.unset(F.col("confidence"), 1.0)).alias("confidence_factor"))
    folder = query_files(queries)
    scored = scan_nearest(folder, rows, k, least, True, None, ("salience_factor", "type_weight", "confidence_factor"), 12)
    best = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).withColumn("candidate_source", F.lit("scan"))


def federated(shards: list[tuple[str, float, DataFrame]], k: int) -> DataFrame:
    """Merges search results of several shards (name, weight, hits): scores weighed, (shard, id) once, the best k of each query."""
    parts = [hits.select("query_id", "id", "similarity", (F.col("score") * weight).alias("score"), F.lit(name).alias("shard")) for name, weight, hits in shards]
    merged = reduce(DataFrame.unionByName, parts).dropDuplicates(["query_id", "shard", "id"])
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "shard", "id")
    return merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def centroids(rows: DataFrame, *keys: str) -> DataFrame:
    """The mean vector per key, component by component; sums are combined before the shuffle."""
    parts = rows.select(*keys, F.posexplode("vector").alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("vector"))


def nearest_centroid(vector: Column, centers: list[list[float]]) -> Column:
    """Number of the nearest centre by squared distance; the lowest among equals."""
    distances = F.array(*[F.struct(X.squared_l2(vector, F.array(*[F.lit(float(x)) for x in c])).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centers)])
    return F.array_min(distances)["i"]


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """Mean share of each query's exact k nearest ids that were found."""
    a = found.groupBy("query_id").agg(F.collect_set("id").alias("got"))
    b = exact.groupBy("query_id").agg(F.collect_set("id").alias("want"))
    return b.join(a, "query_id", "left").agg(F.avg(F.size(F.array_intersect("want", F.coalesce("got", F.array().cast("array<bigint>")))) / F.lit(float(k))).alias("recall"))


def index_needs_build(records: Column, least: int, built: Column, hours_since: Column, interval_hours: float, changed: Column) -> Column:
    """Should an index be built? Enough vectors, and none yet, or the interval is over and something changed."""
    return (records >= least) & (~built | ((hours_since >= interval_hours) & changed))
