"""Inverted file with product quantisation: coarse cells, codes of residuals, search by lookup tables, exact scores at the end.

The codebooks are fitted to all vectors by rounds of partial sums (operators/clustering). Encoding and
search are partition-wise over Arrow batches; the index is a table partitioned by cell, of which a search opens the cells
that its queries probe.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallbase.operators import clustering
from recallbase.operators.clustering import nearest as assign
from recallbase.operators.shared import cut
from recallbase.operators.vectors import STRETCH, by_dim, query_blocks, query_files

#: Queries whose candidates a task holds at once.
TOLD = 64


def bounds(dim: int, parts: int) -> list[tuple[int, int]]:
    """Ranges of the sub-vectors; the first dim % parts are one longer."""
    sizes = [dim // parts + (i < dim % parts) for i in range(parts)]
    ends = np.cumsum(sizes).tolist()
    return [(e - s, e) for s, e in zip(sizes, ends, strict=True)]


def unit(v: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, length, out=v.astype(np.float64).copy(), where=length > 0)


@dataclass
class Codebooks:
    coarse: np.ndarray  # (cells, dim)
    books: list[np.ndarray]  # per sub-vector (codes, width)

    @property
    def ranges(self) -> list[tuple[int, int]]:
        return bounds(self.coarse.shape[1], len(self.books))

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, codes) of unit vectors."""
        cell = assign(v, self.coarse)
        rest = v - self.coarse[cell]
        return cell, np.stack([assign(rest[:, a:b], book) for (a, b), book in zip(self.ranges, self.books, strict=True)], 1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of a query's sub-vectors with all codes: (sub-vectors, codes)."""
        out = np.zeros((len(self.books), max(len(b) for b in self.books)))
        for i, ((a, b), book) in enumerate(zip(self.ranges, self.books, strict=True)):
            out[i, : len(book)] = book @ q[a:b]
        return out


def train(vectors: DataFrame, cells: int = 64, parts: int = 8, codes: int = 64, rounds: int = 8) -> Codebooks:
    """Codebooks of all vectors (id, vector) of the commonest dimension (the smaller of equals): cells first, then codes of what the cells leave, all parts in the same rounds."""
    fine = vectors.where((F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x))).select("id", "vector", F.size("vector").alias("_dim"))
    dim = fine.groupBy("_dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_dim").first()
    if dim is None:
        raise ValueError("no vectors to train on")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    rows = cut(fine.where(F.col("_dim") == dim[0]).select(F.col("id").cast("long").alias("id"), F.when(length > 0, F.transform("vector", lambda x: x / length)).otherwise(F.col("vector").cast("array<double>")).alias("vector")))
    (coarse,) = clustering.lloyd(rows, clustering.seeds(rows, cells), rounds)
    ranges = bounds(dim[0], parts)

    def rests(x: np.ndarray) -> list[np.ndarray]:
        rest = x - coarse[assign(x, coarse)]
        return [rest[:, a:b] for a, b in ranges]

    books = clustering.lloyd(rows, clustering.seeds(rows, min(codes, 256), rests), rounds, rests)
    return Codebooks(coarse.astype(np.float32), [b.astype(np.float32) for b in books])


def encode(vectors: DataFrame, model: Codebooks) -> DataFrame:
    """id, cell and codes of every vector (id, vector) of the model's dimension."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # cells and codes are fixed numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if batch.num_rows:
                cell, codes = m.encode(unit(np.array(batch.column("vector").to_pylist(), np.float64)))
                yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "cell", "codes"])

    return vectors.where(F.size("vector") == model.coarse.shape[1]).select("id", "vector").mapInArrow(work, "id long, cell int, codes binary")


def errors(vectors: DataFrame, model: Codebooks) -> DataFrame:
    """id, cell, coarse_error (squared distance of the unit vector to its cell) and error (to its cell and codes)."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if batch.num_rows:
                x = unit(np.array(batch.column("vector").to_pylist(), np.float64))
                cell, codes = m.encode(x)
                rest = x - m.coarse[cell]
                left = rest - np.concatenate([book[codes[:, i]] for i, book in enumerate(m.books)], 1)
                yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), pa.array(cell.astype(np.int32)), pa.array((rest**2).sum(1)), pa.array((left**2).sum(1))], names=["id", "cell", "coarse_error", "error"])

    return vectors.where(F.size("vector") == model.coarse.shape[1]).select("id", "vector").mapInArrow(work, "id long, cell int, coarse_error double, error double")


def write_index(vectors: DataFrame, model: Codebooks, folder: str) -> None:
    """The index as a table, a folder per cell."""
    encode(vectors, model).write.mode("overwrite").partitionBy("cell").parquet(folder)


def search(spark: SparkSession, folder: str, model: Codebooks, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """query_id, id, estimate, rank: the k best by estimated inner product with unit queries, from the cells of a written index nearest to each query. Ties: least id."""
    return search_rows(spark.read.parquet(folder).select("id", "cell", "codes"), model, queries, k, probes)


def search_rows(rows: DataFrame, model: Codebooks, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """As `search`, in rows (id, cell, codes). Queries are files that every task reads against a stretch of its rows; only cells that a query probes are opened. A stretch keeps k candidates a query over all its cells, and hands them on for TOLD queries at a time."""
    folder = query_files(queries)
    shared = rows.sparkSession.sparkContext.broadcast(model)  # cells and codes are fixed numbers

    def near(q: np.ndarray) -> np.ndarray:
        """The cells that each unit query probes."""
        c = shared.value.coarse.astype(np.float64)
        return np.argsort((c**2).sum(1)[None, :] - 2 * q @ c.T, axis=1, kind="stable")[:, :probes]

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query_id, unit vector) of the model's dimension, block by block."""
        for block in query_blocks(folder):
            for at, v, length in by_dim(block["vector"]):
                if v.shape[1] == shared.value.coarse.shape[1]:
                    yield block["query_id"].to_numpy()[at], v / length[:, None]

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, v, length in by_dim(batch.column("vector")):
                if v.shape[1] == shared.value.coarse.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(near(v / length[:, None])).astype(np.int32))], names=["cell"])

    def scan(part: pa.Table) -> Iterator[pa.RecordBatch]:
        m, own, cell = shared.value, part["id"].to_numpy(), part["cell"].to_numpy()
        codes = np.array([np.frombuffer(x, np.uint8) for x in part["codes"].to_pylist()]).reshape(part.num_rows, -1)
        places = {c: np.flatnonzero(cell == c) for c in np.unique(cell).tolist()}
        for names, q in blocks():
            probes_of = near(q)
            base = q @ m.coarse.astype(np.float64).T
            asked = np.flatnonzero(np.isin(probes_of, list(places)).any(1)).tolist()
            for a in range(0, len(asked), TOLD):
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for i in asked[a : a + TOLD]:
                    table, ids, estimates = m.tables(q[i]), [], []
                    for c in probes_of[i].tolist():
                        if c in places:
                            at = places[c]
                            ids.append(own[at])
                            estimates.append(base[i, c] + table[np.arange(codes.shape[1])[None, :], codes[at]].sum(1))
                    ids, s = np.concatenate(ids), np.concatenate(estimates)
                    other = ids != names[i]
                    ids, s = ids[other], s[other]
                    if len(s) > k:
                        least = -np.partition(-s, k - 1)[k - 1]
                        ids, s = ids[s >= least], s[s >= least]
                    top = np.lexsort((ids, -s))[:k]
                    out.append((np.full(len(top), names[i]), ids[top], s[top]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["query_id", "id", "estimate"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= STRETCH:
                yield from scan(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from scan(pa.Table.from_batches(held))

    cells = [r.cell for r in rows.sparkSession.read.parquet(folder).mapInArrow(probed, "cell int").distinct().collect()]  # as many as the model has, at most
    index = rows.where(F.col("cell").isin(cells)).select(F.col("id").cast("long").alias("id"), "cell", "codes")
    best = Window.partitionBy("query_id").orderBy(F.desc("estimate"), "id")
    found = index.mapInArrow(work, "query_id long, id long, estimate double")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
