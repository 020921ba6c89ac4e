"""Approximate nearest neighbours: a navigable small-world hierarchy per shard, kept as flat neighbour arrays, results merged.

Distinct vectors are dealt by hash into shards of about SHARD points. Each shard's graph has layers: a vector is in layer
l with chance FAN^-l, by its hash. A layer is built by insertion: points come in batches, each is searched for in the graph
so far, its candidates are thinned by the usual rule (one nearer to a chosen neighbour than to the point is passed over)
and linked both ways, and a point with too many links is thinned by the same rule. Nearest is by inner product, as in
the search, which leads to the long vectors that win by it; where lengths differ, a second graph by angle, whose links
are added, keeps vectors together that no long one leads to. A shard is one file: ids, vectors and, for every layer, its
members and their neighbours, flat. A search walks greedily down the layers and then widens in the lowest one with a
beam of BEAM.

Queries are a stated set. Each is dealt to every shard of its dimension, since vectors are dealt by hash and any shard
may hold its neighbours; a shard's queries come in runs of at most about RUN, in different tasks while cores are idle.
Each shard answers with its best vectors, scored in double precision; a window keeps each query's best. Equal
vectors are one point of the graph that carries its smallest ids, as many as a query can return, so a vector that a third
of all rows share costs one point. Nothing but counts goes to the driver.

Nulls and ties: null, empty, all-zero vectors and those with null or non-finite components take no part, neither do null
ids; vectors of different dimensions have no inner product and are indexed and searched apart, and so are magnitudes
that lie further apart than single precision bears: shards are of one dimension and one range of 2^SCALE lengths, and a graph sees
vectors divided by the longest, queries divided by their own length. Where inner products leave the range of doubles, so that they are
equal or infinite for many rows, a shard is read from end to end instead. Equal scores go to the smaller id. Repeated ids are rows of their own; such a query is asked once, with its smallest vector, and leaves out
every row of its id. Extra columns are ignored. An empty table gives no rows.
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

#: Distinct vectors of a shard, about, and bytes of them at most; queries of a shard in one task, about; layer thinning.
SHARD, SHARD_BYTES, RUN, FAN = 32_768, 64 << 20, 2048, 16
#: Binary digits of the lengths in one index; exponents that a product of two lengths may have for the graph to be asked.
SCALE, SAFE = 32, (-900, 1000)
#: Links that a new point makes, those it keeps, the same of the second graph by angle; beams of insertion and search; points of a batch.
LINKS, WIDTH, LINKS_ANGLE, WIDTH_ANGLE, GROW, BEAM, BATCH = 20, 40, 10, 20, 64, 192, 1024


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, vec (array of double), dim, scale (the range of its largest component) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).where("vec_id is not null and vec is not null")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    largest = F.array_max(F.transform("vec", F.abs))
    return rows.where(fine).withColumn("dim", F.size("vec")).withColumn("scale", F.floor(F.log2(largest) / SCALE + 0.5).cast("int"))


def distinct_points(rows: DataFrame, keep: int) -> DataFrame:
    """vec, dim, scale and the `keep` smallest vec_ids. The window is cut short before the shuffle, so a vector that many rows share stays small."""
    near = Window.partitionBy("vec").orderBy("vec_id")
    return rows.withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= keep).groupBy("vec", "dim", "scale").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def _thin(dots: np.ndarray, pair: np.ndarray, links: int) -> np.ndarray:
    """Of each row's candidates, nearest first (-inf: none), the positions of those to link, -1 for none. Room that is left goes to the nearest that were passed over."""
    m, c = dots.shape
    real, chosen, count = dots > -np.inf, np.zeros((m, c), bool), np.zeros(m, np.int64)
    rival = np.full((m, c), -np.inf, np.float32)  # nearness of each candidate to those chosen
    for k in range(c):
        take = np.flatnonzero(real[:, k] & (rival[:, k] < dots[:, k]) & (count < links))
        chosen[take, k] = True
        count[take] += 1
        rival[take] = np.maximum(rival[take], pair[take, k])
    order = np.argsort(np.where(chosen, 0, np.where(real, 1, 2)) * c + np.arange(c), axis=1)[:, :links]
    return np.where(np.take_along_axis(real, order, 1), order, -1)


def _choose(v: np.ndarray, near: np.ndarray, dots: np.ndarray, links: int) -> np.ndarray:
    """The links of points with candidates `near` at nearness `dots`, in any order, -1 for none."""
    out = np.full((len(near), links), -1, np.int32)
    for a in range(0, len(near), BATCH):
        order = np.argsort(-dots[a : a + BATCH], axis=1, kind="stable")[:, : max(GROW, links)]
        cand, nearness = np.take_along_axis(near[a : a + BATCH], order, 1), np.take_along_axis(dots[a : a + BATCH], order, 1)
        held = v[np.maximum(cand, 0)]
        pick = _thin(nearness, held @ held.transpose(0, 2, 1), links)
        out[a : a + BATCH, : pick.shape[1]] = np.where(pick >= 0, np.take_along_axis(cand, np.maximum(pick, 0), 1), -1)
    return out


def walk(q: np.ndarray, v: np.ndarray, links: np.ndarray, at: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The beam of every query, from the points `at` on: rows of v (-1 for none) and inner products, best first. All queries step together."""
    nq = len(q)
    rows, dots, done = np.full((nq, beam), -1, np.int32), np.full((nq, beam), -np.inf, np.float32), np.ones((nq, beam), bool)
    rows[:, 0], dots[:, 0], done[:, 0] = at, np.einsum("ij,ij->i", v[at], q), False
    seen = np.zeros((nq, len(v)), bool)
    seen[np.arange(nq), at] = True
    moving = np.arange(nq)
    while len(moving):
        held, over = dots[moving], done[moving]
        k = np.where(over, -np.inf, held).argmax(1)
        node = rows[moving, k]
        done[moving, k] = over[np.arange(len(moving)), k] = True
        near = links[node]
        who, col = np.nonzero((near >= 0) & ~seen[moving[:, None], near])
        point, asker = near[who, col], moving[who]
        seen[asker, point] = True
        nearness = np.einsum("ij,ij->i", v[point], q[asker])
        good = nearness > held.min(1)[who]
        who, point, nearness = who[good], point[good], nearness[good]
        each = np.bincount(who, minlength=len(moving))
        got = np.flatnonzero(each)
        if len(got):
            place = np.arange(len(who)) - np.repeat(np.cumsum(each) - each, each)
            more = np.full((len(moving), int(each.max())), -np.inf, np.float32)
            names = np.full(more.shape, -1, np.int32)
            more[who, place], names[who, place] = nearness, point
            asker = moving[got]
            all_dots, all_rows = np.concatenate([held[got], more[got]], 1), np.concatenate([rows[asker], names[got]], 1)
            all_done = np.concatenate([over[got], more[got] == -np.inf], 1)
            keep = np.argpartition(-all_dots, beam - 1, axis=1)[:, :beam]
            rows[asker], dots[asker], done[asker] = (np.take_along_axis(x, keep, 1) for x in (all_rows, all_dots, all_done))
        moving = moving[~done[moving].all(1)]
    order = np.argsort(-dots, axis=1, kind="stable")
    return np.take_along_axis(rows, order, 1), np.take_along_axis(dots, order, 1)


def _prune(v: np.ndarray, links: np.ndarray, count: np.ndarray, full: np.ndarray, width: int) -> None:
    """Thins the links of these points to `width`."""
    near = links[full]
    dots = np.where(near >= 0, np.einsum("ijk,ik->ij", v[np.maximum(near, 0)], v[full]), -np.inf).astype(np.float32)
    links[full] = -1
    links[full, :width] = _choose(v, near, dots, width)
    count[full] = (links[full] >= 0).sum(1)


def _graph(v: np.ndarray, own: int, width: int) -> np.ndarray:
    """Neighbours of every row of v by inner product, by insertion in the order of the rows, `width` at most, padded with -1."""
    n, cap = len(v), width + width // 2  # a point is thinned when it has no room left, and once more in the end
    links, count = np.full((n, cap), -1, np.int32), np.zeros(n, np.int64)
    for a in range(0, n, BATCH):
        me = np.arange(a, min(n, a + BATCH))
        q = v[me]
        each = q @ q.T  # points of a batch don't find each other in the graph
        np.fill_diagonal(each, -np.inf)
        c = min(GROW if a == 0 else GROW // 4, len(me) - 1)
        near = np.argpartition(-each, c - 1, axis=1)[:, :c] if c > 0 else np.zeros((len(me), 0), np.int64)
        dots, near = np.take_along_axis(each, near, 1), (near + a).astype(np.int32)
        if a:
            start = (q @ v[:BATCH].T).argmax(1)
            found = [walk(q[x : x + 512], v[:a], links[:a], start[x : x + 512], GROW) for x in range(0, len(me), 512)]
            near = np.concatenate([near, np.concatenate([f[0] for f in found])], 1)
            dots = np.concatenate([dots, np.concatenate([f[1] for f in found])], 1)
        chosen = _choose(v, near, dots, own)
        links[me, :own], count[me] = chosen, (chosen >= 0).sum(1)
        i, k = np.nonzero(chosen >= 0)
        to, by = chosen[i, k], me[i].astype(np.int32)
        single = ~(links[to] == by[:, None]).any(1)
        order = np.argsort(to[single], kind="stable")
        to, by = to[single][order], by[single][order]
        while len(to):
            node, first, times = np.unique(to, return_index=True, return_counts=True)
            room, place = cap - count[node], np.arange(len(to)) - np.repeat(first, times)
            put = place < np.repeat(room, times)
            links[to[put], count[to[put]] + place[put]] = by[put]
            count[node] += np.minimum(times, room)
            to, by = to[~put], by[~put]
            _prune(v, links, count, np.unique(to), width)
    for x in range(0, n, BATCH):
        _prune(v, links, count, x + np.flatnonzero(count[x : x + BATCH] > width), width)
    return links[:, :width].copy()


def scaled(vectors: np.ndarray, each: bool = False) -> np.ndarray:
    """Vectors divided by the longest one's length, or each by its own, whatever their magnitude."""
    whole = None if each else (0, 1)
    if not vectors.size:
        return vectors
    out = vectors / np.abs(vectors).max(axis=1 if each else whole, keepdims=True)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / (norms if each else norms.max())


def build(vectors: np.ndarray, hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers from the lowest up: (members, neighbours as rows of the shard, -1 for none)."""
    alone, vectors = scaled(vectors, each=True), scaled(vectors)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    level = np.floor(-np.log((hashes.astype(np.uint64) >> np.uint64(11)).astype(np.float64) / 2**53 + 2**-54) / np.log(FAN)).astype(np.int64)
    alike = norms.max(initial=0.0) <= 1.001 * norms.min(initial=np.inf)
    layers = []
    for lv in range(int(level.max()) + 1 if len(level) else 0):
        members = np.flatnonzero(level >= lv).astype(np.int32)
        own = vectors[members]
        links = _graph((own / max(norms[members].max(), 1e-30)).astype(np.float32), LINKS, WIDTH)
        if not alike:
            angle = _graph(alone[members].astype(np.float32), LINKS_ANGLE, WIDTH_ANGLE)
            links = np.concatenate([links, np.where((angle[:, :, None] == links[:, None, :]).any(2), -1, angle)], 1)
        layers.append((members, np.where(links >= 0, members[links], -1).astype(np.int32)))
    return layers


def search(queries: np.ndarray, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """The beam of every query: greedy steps down the layers, then `walk` in the lowest one."""
    q, v = scaled(queries, each=True).astype(np.float32), scaled(vectors).astype(np.float32)
    at = np.full(len(q), layers[-1][0][0])
    best = q @ v[at[0]] if len(q) else np.zeros(0, np.float32)
    for members, links in reversed(layers[1:]):
        where = np.full(len(v), -1, np.int64)
        where[members] = np.arange(len(members))
        moving = np.arange(len(q))
        while len(moving):
            near = links[where[at[moving]]]
            dots = np.where(near >= 0, np.einsum("qkd,qd->qk", v[np.maximum(near, 0)], q[moving]), -np.inf)
            k = dots.argmax(1)
            gain = dots[np.arange(len(moving)), k]
            up = gain > best[moving]
            at[moving[up]], best[moving[up]] = near[np.arange(len(moving)), k][up], gain[up]
            moving = moving[up]
    return walk(q, v, layers[0][1], at, beam)


#: Arrays of a shard's file, in turn: distinct vectors, how many ids each has, the ids, sizes of the layers, links of a member, members, neighbours.
_FILE = ("vectors", "counts", "ids", "sizes", "width", "members", "links")


def store(stream, vectors: np.ndarray, counts: np.ndarray, ids: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Writes a shard."""
    sizes, width = np.array([len(m) for m, _ in layers], np.int32), np.array([layers[0][1].shape[1]], np.int32)
    for x in (vectors, counts, ids, sizes, width, np.concatenate([m for m, _ in layers]), np.concatenate([x.ravel() for _, x in layers])):
        np.save(stream, x, allow_pickle=False)


def load(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """vectors, ids, counts and layers of a stored shard."""
    stream = io.BytesIO(raw)
    got = {name: np.load(stream, allow_pickle=False) for name in _FILE}
    layers, m, width = [], 0, int(got["width"][0])
    for size in got["sizes"].tolist():
        layers.append((got["members"][m : m + size], got["links"][m * width : (m + size) * width].reshape(size, width)))
        m += size
    return got["vectors"], got["ids"], got["counts"], layers


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column in turn, and each list's length."""
    joined = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return joined.flatten().to_numpy(zero_copy_only=False), np.diff(joined.offsets.to_numpy()).astype(np.int32)


def index(points: DataFrame, folder: str) -> DataFrame:
    """A row per shard: dim, shard, n, path. The shards themselves are files in the folder; every point is in one."""
    held = cut(points.withColumn("_hash", F.xxhash64("vec")))
    most = F.least(F.lit(SHARD), F.greatest(F.lit(1), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("dim")))))
    sizes = held.groupBy("dim", "scale").agg(F.ceil(F.count("*") / most).cast("long").alias("_shards"))  # a row per length and range of vectors
    dealt = held.join(F.broadcast(sizes), ["dim", "scale"]).withColumn("_shard", F.pmod(F.xxhash64(F.col("_hash")), "_shards"))

    def make(part: pa.Table) -> pa.Table:
        files, top = pafs.FileSystem.from_uri(folder)
        part = part.sort_by("_hash")
        values, lengths = _lists(part["vec"])
        vectors = values.reshape(len(lengths), -1)
        ids, counts = _lists(part["ids"])
        layers = build(vectors, part["_hash"].to_numpy())
        dim, scale, shard = (part[c][0].as_py() for c in ("dim", "scale", "_shard"))
        name, draft = f"{top}/{dim}-{scale}-{shard}.graph", f"{top}/.{uuid.uuid4().hex}"
        files.create_dir(top, recursive=True)
        with files.open_output_stream(draft) as stream:
            store(stream, vectors, counts, ids, layers)
        files.move(draft, name)  # a task that runs again replaces its own file
        return pa.table({"dim": [dim], "shard": [shard], "n": [len(vectors)], "path": [name]}, pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("n", pa.int64()), ("path", pa.string())]))

    shards = sizes.agg(F.sum("_shards")).first()[0] or 1
    return cut(dealt.repartition(2 * shards, "dim", "scale", "_shard").groupBy("dim", "scale", "_shard").applyInArrow(make, "dim int, shard long, n long, path string"))


def _answers(who: np.ndarray, queries: np.ndarray, held: tuple, k: int) -> pa.RecordBatch:
    """The k best rows of a shard for each query, by exact scores."""
    own, ids, counts, layers = held
    size = np.frexp(np.abs(queries).max(1))[1] + np.frexp(np.abs(own).max())[1]
    whole = (size < SAFE[0]) | (size > SAFE[1])
    if whole.any() and not whole.all():
        return pa.Table.from_batches([_answers(who[x], queries[x], held, k) for x in (whole, ~whole)]).combine_chunks().to_batches()[0]
    if whole.all():
        with np.errstate(over="ignore", invalid="ignore", under="ignore"):
            every = np.nan_to_num(queries @ own.T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        first = ids[np.cumsum(counts) - counts]
        at = np.stack([np.lexsort((first, -x))[: 2 * k] for x in every])
        exact, real = np.take_along_axis(every, at, 1), np.ones(at.shape, bool)
    else:
        at, _ = search(queries, own, layers)
        at = at[:, : 2 * k]
        real = at >= 0
        exact = np.where(real, np.einsum("qkd,qd->qk", own[np.maximum(at, 0)], queries), -np.inf)
    row, place = np.nonzero(real)
    point = at[row, place]
    each = counts[point]
    ends = np.concatenate([[0], np.cumsum(counts)])
    who_of, score = np.repeat(who[row], each), np.repeat(exact[row, place], each)
    ids_of = ids[np.repeat(ends[point] - np.cumsum(each) + each, each) + np.arange(each.sum())]
    other = who_of != ids_of
    order = np.lexsort((ids_of[other], -score[other], who_of[other]))
    w, i, s = who_of[other][order], ids_of[other][order], score[other][order]
    begin = np.flatnonzero(np.diff(w, prepend=w[:1] - 1) != 0)
    rank = np.arange(len(w)) - np.repeat(begin, np.diff(np.append(begin, len(w))))
    return pa.RecordBatch.from_arrays([pa.array(w[rank < k]), pa.array(i[rank < k]), pa.array(s[rank < k])], names=["query_id", "vec_id", "score"])


def ask(asked: DataFrame, shards: DataFrame, folder: str, k: int) -> DataFrame:
    """query_id, vec_id, score: what each shard answers to each query (vec_id, vec, dim)."""
    n, queries = shards.count(), asked.count()
    parts = max(1, min(-(-queries // RUN), -(-asked.sparkSession.sparkContext.defaultParallelism // max(1, n))))
    keys = ("path", "part")
    files_of = shards.select("dim", "path")
    dealt = asked.join(F.broadcast(files_of) if n <= 100_000 else files_of, "dim").select("path", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("part"), "vec_id", "vec")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = pafs.FileSystem.from_uri(folder)
        path, held = None, None
        for batch in batches:
            names = np.array(batch.column("path").to_pylist())
            edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for a, b in zip(edges, edges[1:], strict=False):
                if b > a and names[a] != path:
                    path = names[a]
                    with files.open_input_file(str(path)) as stream:
                        held = load(stream.read())
                for x in range(a, b, 512):
                    some = batch.slice(x, min(512, b - x))
                    vectors, lengths = _lists(pa.chunked_array([some.column("vec")]))
                    yield _answers(some.column("vec_id").to_numpy(), vectors.reshape(len(lengths), -1), held, k)

    return dealt.repartition(max(1, n * parts), *keys).sortWithinPartitions(*keys).mapInArrow(work, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k nearest other rows found, by largest inner product."""
    folder = shared_dir(vectors.sparkSession)
    rows = cut(usable(vectors, id_col, vec_col))
    shards = index(distinct_points(rows, k + 1), folder)
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min_by(F.struct("vec", "dim"), "vec").alias("q")).select("vec_id", "q.vec", "q.dim")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = ask(asked, shards, folder, k)
    return merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
