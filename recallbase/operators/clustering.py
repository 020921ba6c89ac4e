"""k-means over all rows: seeds by weighted sampling in parallel, then Lloyd's rounds of partial sums.

A round reads every row once. A task adds up its rows by nearest centre and hands on a sum for each centre, whatever its
rows are; those sums meet in a shuffle of tasks times centres. Coordinates are taken in whole multiples of 2^-GRID,
so sums are exact and a task that runs again, or rows that lie otherwise, change nothing. Centres, a fixed number of them, go through the
driver and to all tasks; rows never do.

Several codebooks over parts of the same vectors are trained in the same rounds: `split` cuts a table of vectors into one table for each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Binary digits behind the point; rounds of seeding, and candidates that one adds for each centre that is wanted.
GRID, SEED_ROUNDS, OVERSAMPLING = 30, 4, 2

Split = Callable[[np.ndarray], list[np.ndarray]]


def whole(x: np.ndarray) -> list[np.ndarray]:
    """One codebook over whole vectors."""
    return [x]


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centers.T + (centers**2).sum(1)[None, :], 0)


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, the first of equals."""
    return distances(np.asarray(x, np.float64), np.asarray(centers, np.float64)).argmin(1)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and vectors of batches (id, vector) of equal dimension."""
    for batch in batches:
        if batch.num_rows:
            column = batch.column("vector")
            yield batch.column("id").to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def lloyd_round(vectors: DataFrame, centers: list[np.ndarray], split: Split = whole) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(centres, counts) of each codebook after one round over all rows (id, vector). A centre without rows stays."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(c.shape, np.int64) for c in centers]
        counts = [np.zeros(len(c), np.int64) for c in centers]
        for _, x in _tables(batches):
            for s, n, part, c in zip(sums, counts, split(x), centers, strict=True):
                own = nearest(part, c)
                np.add.at(s, own, np.rint(part * 2.0**GRID).astype(np.int64))
                n += np.bincount(own, minlength=len(c))
        for book, (s, n) in enumerate(zip(sums, counts, strict=True)):
            some = np.flatnonzero(n)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), book, np.int32)), pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(list(s[some]), pa.list_(pa.int64()))], names=["book", "center", "n", "sums"])

    parts = vectors.select("id", "vector").mapInArrow(add, "book int, center int, n long, sums array<long>")
    each = parts.select("book", "center", "n", F.posexplode("sums").alias("at", "sum")).groupBy("book", "center", "at").agg(F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"))
    out, counts = [c.astype(np.float64).copy() for c in centers], [np.zeros(len(c), np.int64) for c in centers]
    for r in each.collect():  # a row for each coordinate of each centre
        out[r.book][r.center, r.at] = float(r.sum) / r.n / 2.0**GRID
        counts[r.book][r.center] = r.n
    return out, counts


def lloyd(vectors: DataFrame, centers: list[np.ndarray], rounds: int, split: Split = whole) -> list[np.ndarray]:
    """Centres after at most `rounds` rounds; it ends when none moves."""
    for _ in range(rounds):
        moved, _ = lloyd_round(vectors, centers, split)
        if all(np.array_equal(a, b) for a, b in zip(moved, centers, strict=True)):
            break
        centers = moved
    return centers


def _chances(ids: np.ndarray, turn: int) -> np.ndarray:
    """A number above 0 and below 1 for each id and turn, the same wherever the row stands."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn + 1) * np.uint64(0xD1B54A32D192ED03)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52


def _sampled(vectors: DataFrame, held: list[np.ndarray] | None, most: int, turn: int, split: Split) -> list[np.ndarray]:
    """Of each codebook up to `most` rows, taken without repeats with chances as their squared distances to those held."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for ids, x in _tables(batches):
            for book, part in enumerate(split(x)):
                weight = np.ones(len(x)) if held is None else distances(part, held[book]).min(1)
                with np.errstate(divide="ignore"):
                    key = np.where(weight > 1e-12, np.log(_chances(ids, turn)) / weight, -np.inf)
                old = best.get(book, (np.zeros(0), np.zeros(0, np.int64), np.zeros((0, part.shape[1]))))
                key, who, rows = np.concatenate([old[0], key]), np.concatenate([old[1], ids]), np.concatenate([old[2], part])
                top = np.lexsort((who, -key))[:most]
                top = top[key[top] > -np.inf]
                best[book] = (key[top], who[top], rows[top])
        for book, (key, who, rows) in best.items():
            if len(key):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), book, np.int32)), pa.array(key), pa.array(who.astype(np.int64)), pa.array(list(rows), pa.list_(pa.float64()))], names=["book", "key", "id", "row"])

    first = Window.partitionBy("book").orderBy(F.desc("key"), "id")
    some = vectors.select("id", "vector").mapInArrow(take, "book int, key double, id long, row array<double>").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most)
    out: dict[int, list] = {}
    for r in some.orderBy("book", "_n").collect():  # `most` rows a codebook
        out.setdefault(r.book, []).append(r.row)
    books = max(out, default=-1) + 1 if held is None else len(held)
    return [np.array(out.get(b, np.zeros((0, 0 if held is None else held[b].shape[1]))), np.float64) for b in range(books)]


def seeds(vectors: DataFrame, k: int, split: Split = whole) -> list[np.ndarray]:
    """Up to k seeds of each codebook: SEED_ROUNDS passes each add candidates far from those before, all rows are counted to their nearest candidate, and the heaviest far ones are taken."""
    held = _sampled(vectors, None, 1, 0, split)
    for turn in range(1, SEED_ROUNDS + 1):
        more = _sampled(vectors, held, OVERSAMPLING * k, turn, split)
        held = [np.concatenate([a, b]) if len(b) else a for a, b in zip(held, more, strict=True)]
    _, weights = lloyd_round(vectors, held, split)
    out = []
    for points, weight in zip(held, weights, strict=True):
        picked = [int(weight.argmax())] if len(points) else []
        far = distances(points, points[picked]).min(1) if picked else np.zeros(0)
        while len(picked) < k and (far * weight).max(initial=0) > 0:
            picked.append(int((far * weight).argmax()))
            far = np.minimum(far, distances(points, points[picked[-1:]])[:, 0])
        out.append(points[picked])
    return out
