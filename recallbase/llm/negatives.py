"""Hard negatives by a pivot table: rows of another label whose score lies in a window below that of a positive.

A vector x gets one more component, sqrt(M^2 - |x|^2), M being the largest norm, and an anchor q gets 0 there. Then
|q - x|^2 = |q|^2 + M^2 - 2 q.x, so that the largest inner product is the smallest Euclidean distance and the triangle
inequality holds. The table stores the distance of every row to PIVOTS rows that lie far from one another. For a row, or
for many rows by the least and largest of their stored distances, |d(q,p) - d(x,p)| <= d(q,x) <= d(q,p) + d(x,p) over all
pivots brackets the score. Rows whose bracket misses what an anchor still looks for aren't read; the others are checked
exactly, in whole numbers.

Rows are dealt into blocks by their nearest pivot, several blocks where many rows share one. A block is a file in the shared
folder: ids, labels, vectors, stored distances, and leaves of LEAF rows with the bounds of their distances. An anchor asks the block
that it lies in first, which says how good a row must be to matter; after that it is sent only to those blocks whose
bounds allow such rows. This is done once for the positives and once for the negatives, whose windows follow
from the positives' scores. Each block answers with its best rows, and a window keeps the best of all. Anchors are a stated set; a
task holds one block and goes through its anchors in small batches.

Nulls and ties: rows with a null id, label or vector, or with a null or non-finite component, take no part, nor do those
whose whole-number vector is 2^31 long or longer, since scores must fit a long; zero vectors do. Vectors of different
length have no inner product and don't meet. Equal scores go by the smaller id. Repeated ids are rows of
their own, but an anchor is asked once, with its smallest label and vector, and leaves out all rows of its id. Extra columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallbase.llm.common import cut, shared_dir

#: Pivots of the vectors of a length, and rows of the sample they are chosen from.
PIVOTS, SAMPLE = 16, 2048
#: Rows of a block, about, and bytes of its vectors at most; rows of a leaf; anchors that a task takes to a block, about; blocks that bounds are sent around for.
BLOCK, BLOCK_BYTES, LEAF, RUN, MOST_BLOCKS = 16_384, 32 << 20, 128, 2048, 50_000
#: Positives of an anchor, negatives of a positive, and the window of a negative's score in percent of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90

_ASKED = "anchor_id long, place int, row_id long, score long"
_FILE = ("ids", "labels", "vectors", "far", "leaf_lo", "leaf_hi")


def usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: float) -> DataFrame:
    """vec_id, label, vec (whole numbers floor(scale * x), as double), dim, norm2 of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("vec")).dropna()
    limit = float(1 << 31)
    fine = rows.where(F.forall("vec", lambda x: F.coalesce(F.abs(x) * scale < limit, F.lit(False)) & ~F.isnan(x)))
    whole = fine.withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale).cast("double"))).withColumn("dim", F.size("vec"))
    norm2 = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    return whole.withColumn("norm2", norm2).where(F.col("norm2") < limit * limit)


def choose_pivots(points: np.ndarray, tail: np.ndarray, most: int) -> np.ndarray:
    """Places of up to `most` rows, each the farthest from those before; the first is the farthest from the mean."""
    whole = np.concatenate([points, tail[:, None]], 1)
    near = ((whole - whole.mean(0)) ** 2).sum(1)
    out: list[int] = []
    while len(out) < most and (not out or near.max() > 0):
        out.append(int(near.argmax()))
        d = ((whole - whole[out[-1]]) ** 2).sum(1)
        near = d if len(out) == 1 else np.minimum(near, d)
    return np.array(out)


def distances(points: np.ndarray, tail: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of rows with a further component `tail` to all pivots, which have theirs at the end."""
    out = np.empty((len(points), len(pivots)))
    for k, p in enumerate(pivots):
        out[:, k] = np.sqrt(((points - p[:-1]) ** 2).sum(1) + (tail - p[-1]) ** 2)
    return out


def brackets(lo: np.ndarray, hi: np.ndarray, asked: np.ndarray, square: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of rows whose distances to the pivots lie in lo..hi, for an anchor with distances `asked`. square: |q|^2 + M^2."""
    near = np.maximum(np.maximum(lo - asked, asked - hi), 0).max(-1)
    far = (asked + hi).min(-1)
    slack = 1e-9 * square + 1e-3  # of rounding
    return (square - far * far) / 2 - slack, (square - near * near) / 2 + slack


def scores(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products as whole numbers, each below 2^62."""
    if np.abs(vectors).max(initial=0) * np.abs(q).max(initial=0) * max(1, len(q)) < 2.0**53:
        return (vectors @ q).astype(np.int64)
    return (vectors.astype(np.int64) * q.astype(np.int64)).sum(1)


def search(block: dict[str, np.ndarray], anchor: dict, same: bool, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(window, ids, scores): an anchor's k best rows in each of its windows lo[w]..hi[w], of its label or of all others."""
    lo, hi = anchor["lo"], anchor["hi"]
    if not len(lo):
        return
    floor, top, asked, square = lo.min(), hi.max(), anchor["far"], anchor["square"]
    low, high = brackets(block["leaf_lo"], block["leaf_hi"], asked, square)
    n = len(block["ids"])
    leaves = np.flatnonzero((high >= floor) & (low <= top))
    rows = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
    rows = rows[rows < n]
    rows = rows[((block["labels"][rows] == anchor["label"]) == same) & (block["ids"][rows] != anchor["id"])]
    far = block["far"][rows]
    low, high = brackets(far, far, asked, square)
    rows = rows[(high >= floor) & (low <= top)]
    exact, ids = scores(block["vectors"][rows], anchor["vec"]), block["ids"][rows]
    for w in range(len(lo)):
        some = np.flatnonzero((exact >= lo[w]) & (exact <= hi[w]))
        if len(some) > k:
            some = some[exact[some] >= np.partition(exact[some], len(some) - k)[len(some) - k]]
        best = some[np.lexsort((ids[some], -exact[some]))[:k]]
        yield w, ids[best], exact[best]


def _lists(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of lists of equal length as a table."""
    joined = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return joined.flatten().to_numpy(zero_copy_only=False).reshape(len(joined), -1) if len(joined) and len(joined[0]) else np.zeros((len(joined), 0))


def pivot_files(rows: DataFrame, folder: str) -> DataFrame:
    """dim, n, m2 (largest squared norm) of each length of vectors. Its pivots are a file in the folder, chosen from a sample by hash."""
    first = Window.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id")
    sample = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= SAMPLE).drop("_n")
    of_dim = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm2").alias("m2"))

    def choose(part: pa.Table) -> pa.Table:
        part = part.sort_by([("vec_id", "ascending"), ("norm2", "ascending")])
        points, m2 = _lists(part["vec"]), part["m2"][0].as_py()
        tail = np.sqrt(m2 - part["norm2"].to_numpy())
        at = choose_pivots(points, tail, PIVOTS)
        files, top = pafs.FileSystem.from_uri(folder)
        files.create_dir(top, recursive=True)
        dim, draft = part["dim"][0].as_py(), f"{top}/.{uuid.uuid4().hex}"
        with files.open_output_stream(draft) as stream:
            np.save(stream, np.concatenate([points[at], tail[at, None]], 1), allow_pickle=False)
        files.move(draft, f"{top}/{dim}.pivots")  # a task that runs again replaces its own file
        return pa.table({"dim": [dim], "n": part["n"][:1].combine_chunks(), "m2": [m2]}, pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("m2", pa.float64())]))

    joined = sample.join(F.broadcast(of_dim), "dim").select("dim", "vec_id", "vec", "norm2", "n", "m2")  # a row per length of vectors
    return cut(joined.groupBy("dim").applyInArrow(choose, "dim int, n long, m2 double"))


def with_distances(rows: DataFrame, dims: DataFrame, folder: str) -> DataFrame:
    """rows with far (distances to the pivots), cell (the nearest), square (own and largest squared norm) and anchored, the distances of the row as an anchor."""
    joined = rows.join(F.broadcast(dims.select("dim", "m2")), "dim").select("vec_id", "label", "vec", "dim", "norm2", "m2")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = pafs.FileSystem.from_uri(folder)
        known, dim = None, None
        for batch in batches:
            of = batch.column("dim").to_numpy()
            for one in np.unique(of).tolist():
                if one != dim:
                    with files.open_input_file(f"{top}/{one}.pivots") as stream:
                        dim, known = one, np.load(io.BytesIO(stream.read()), allow_pickle=False)
                part = batch.filter(pa.array(of == one))
                points, norm2, m2 = _lists(part.column("vec")), part.column("norm2").to_numpy(), part.column("m2").to_numpy()
                far = distances(points, np.sqrt(m2 - norm2), known)
                asked = distances(points, np.zeros(len(points)), known)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())) for x in (far, asked)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("vec_id", "label", "vec", "dim")), lists[0], lists[1], pa.array(far.argmin(1).astype(np.int32)), pa.array(norm2 + m2)],
                    names=["vec_id", "label", "vec", "dim", "far", "anchored", "cell", "square"],
                )

    return joined.mapInArrow(measure, "vec_id long, label long, vec array<double>, dim int, far array<double>, anchored array<double>, cell int, square double")


def _store(folder: str, name: str, block: dict[str, np.ndarray]) -> str:
    files, top = pafs.FileSystem.from_uri(folder)
    draft = f"{top}/.{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as stream:
        for key in _FILE:
            np.save(stream, block[key], allow_pickle=False)
    files.move(draft, f"{top}/{name}")
    return f"{top}/{name}"


def _load(folder: str, path: str) -> dict[str, np.ndarray]:
    files, _ = pafs.FileSystem.from_uri(folder)
    with files.open_input_file(path) as stream:
        raw = io.BytesIO(stream.read())
    return {key: np.load(raw, allow_pickle=False) for key in _FILE}


def blocks(rows: DataFrame, dims: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """The rows with their block's number, and a row per block: dim, cell, block, path, n, lo, hi. rows: of with_distances, cut."""
    room = F.greatest(F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_BYTES) / (8 * F.greatest("dim", F.lit(1))))), F.floor(F.col("_n") / MOST_BLOCKS), F.lit(1))
    shares = rows.groupBy("dim", "cell").agg(F.count("*").alias("_rows")).join(F.broadcast(dims.select("dim", F.col("n").alias("_n"))), "dim")
    shares = shares.select("dim", "cell", F.ceil(F.col("_rows") / room).cast("long").alias("_blocks"))  # PIVOTS rows per length of vectors
    shares = cut(shares, 0)
    dealt = rows.join(F.broadcast(shares), ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("vec_id", "vec", "label"), "_blocks")).drop("_blocks")

    def make(part: pa.Table) -> pa.Table:
        dim, cell, number = (part[c][0].as_py() for c in ("dim", "cell", "block"))
        far = _lists(part["far"])
        order = np.lexsort((part["vec_id"].to_numpy(), far[:, cell]))
        far = far[order]
        edges = np.arange(0, len(far), LEAF)
        block = {
            "ids": part["vec_id"].to_numpy()[order], "labels": part["label"].to_numpy()[order], "vectors": _lists(part["vec"])[order], "far": far,
            "leaf_lo": np.minimum.reduceat(far, edges), "leaf_hi": np.maximum.reduceat(far, edges),
        }
        path = _store(folder, f"{dim}-{cell}-{number}.block", block)
        names = [("dim", pa.int32()), ("cell", pa.int32()), ("block", pa.int64()), ("path", pa.string()), ("n", pa.int64()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))]
        return pa.table({"dim": [dim], "cell": [cell], "block": [number], "path": [path], "n": [len(far)], "lo": [far.min(0)], "hi": [far.max(0)]}, pa.schema(names))

    total = shares.agg(F.sum("_blocks")).first()[0] or 1
    made = dealt.select("dim", "cell", "block", "vec_id", "label", "vec", "far").repartition(2 * total, "dim", "cell", "block").groupBy("dim", "cell", "block")
    return dealt, cut(made.applyInArrow(make, "dim int, cell int, block long, path string, n long, lo array<double>, hi array<double>"), 0)


def ask(asked: DataFrame, anchors: int, total: int, folder: str, same: bool, k: int) -> DataFrame:
    """anchor_id, place, row_id, score: what blocks answer. asked: vec_id, label, vec, anchored, square, lo, hi (arrays: the windows, their numbers being places) and the path of a block."""
    parts = max(1, -(-anchors // RUN))
    keyed = asked.select("path", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("part"), "vec_id", "label", "vec", "anchored", "square", "lo", "hi")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, block = None, None
        for batch in batches:
            out: dict[str, list] = {"anchor_id": [], "place": [], "row_id": [], "score": []}
            for row in batch.to_pylist():
                if row["path"] != path:
                    path = row["path"]
                    block = _load(folder, path)
                anchor = {"id": row["vec_id"], "label": row["label"], "vec": np.array(row["vec"], np.float64), "far": np.array(row["anchored"]), "square": row["square"], "lo": np.array(row["lo"], np.int64), "hi": np.array(row["hi"], np.int64)}
                for w, ids, found in search(block, anchor, same, k):
                    out["anchor_id"].append(np.full(len(ids), row["vec_id"]))
                    out["place"].append(np.full(len(ids), w, np.int32))
                    out["row_id"].append(ids)
                    out["score"].append(found)
            if out["score"]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out.values()], names=list(out))

    return keyed.repartition(max(1, total * parts), "path", "part").sortWithinPartitions("path", "part").mapInArrow(work, _ASKED)


def _elsewhere(asked: DataFrame, made: DataFrame) -> DataFrame:
    """asked with the path of every block but the own one whose bounds allow a row in one of the windows."""
    bounds = F.broadcast(made.select("dim", "path", F.col("lo").alias("_lo"), F.col("hi").alias("_hi")))  # MOST_BLOCKS rows, and one per pivot, at most
    near = F.greatest(F.lit(0.0), F.array_max(F.zip_with("_lo", "anchored", lambda b, a: b - a)), F.array_max(F.zip_with("anchored", "_hi", lambda a, b: a - b)))
    far = F.array_min(F.zip_with("anchored", "_hi", lambda a, b: a + b))
    slack = 1e-9 * F.col("square") + 1e-3
    allowed = ((F.col("square") - near * near) / 2 + slack >= F.array_min("lo")) & ((F.col("square") - far * far) / 2 - slack <= F.array_max("hi"))
    return asked.withColumnRenamed("path", "_own").join(bounds, "dim").where((F.col("path") != F.col("_own")) & allowed).drop("_own", "_lo", "_hi")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k first of every anchor and place, with their rank."""
    first = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "row_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", every: int = 100, scale: float = 256, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for anchors whose id is divisible by `every`."""
    folder = shared_dir(vectors.sparkSession)
    rows = cut(usable(vectors, id_col, vec_col, label_col, scale))
    dims = pivot_files(rows, folder)
    dealt, made = blocks(cut(with_distances(rows, dims, folder)), dims, folder)
    total = made.count()
    own = dealt.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min_by(F.struct("label", "vec", "dim", "cell", "block", "anchored", "square"), F.struct("label", "vec")).alias("a")).select("vec_id", "a.*")
    least, most = -(1 << 62), 1 << 62
    anchors = cut(own.join(F.broadcast(made.select("dim", "cell", "block", "path")), ["dim", "cell", "block"]).drop("cell", "block"))
    n = anchors.count()

    def round_of(asked: DataFrame, same: bool, k: int) -> DataFrame:
        """The k best of each window: the own block first, whose k-th row then bounds what other blocks are asked for."""
        asked = cut(asked)
        home = cut(_best(ask(asked, n, total, folder, same, k), k))
        full = home.where(F.col("rank") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("_full"))  # a window's number once
        raised = F.transform("lo", lambda x, i: F.coalesce(F.try_element_at("_full", i.cast("int")), x))
        other = asked.join(full, asked["vec_id"] == full["anchor_id"], "left").withColumn("lo", raised).drop("anchor_id", "_full")
        return cut(_best(home.drop("rank").unionByName(ask(_elsewhere(other, made), n, total, folder, same, k)), k))

    near = round_of(anchors.withColumn("lo", F.array(F.lit(least))).withColumn("hi", F.array(F.lit(most))), True, positives)
    found = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "row_id", "score"))).alias("p"))  # `positives` at most
    bounds = found.select(
        F.col("anchor_id").alias("vec_id"),
        F.transform("p", lambda x: F.ceil(x["score"] * F.lit(low).cast("decimal(20,0)") / 100).cast("long")).alias("lo"),
        F.transform("p", lambda x: F.floor(x["score"] * F.lit(high).cast("decimal(20,0)") / 100).cast("long")).alias("hi"),
    )
    hard = round_of(anchors.join(bounds, "vec_id"), False, negatives)
    return hard.join(near.select("anchor_id", (F.col("rank") - 1).alias("place"), F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
