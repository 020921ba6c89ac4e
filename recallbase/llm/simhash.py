"""SimHash fingerprints, linked by BK-trees over shards of fingerprints that share bits, and their components.

Two 64-bit fingerprints that differ in at most r bits agree fully on at least one of r + 1 blocks of bits (and on k of
r + k blocks). So a shard is all distinct fingerprints with the same value in the same block(s): every link lies within
a shard, and more blocks are used as the count grows, so that shards of unrelated fingerprints stay small. Each shard
is a BK-tree: children keyed by their integer distance to the parent, a search follows only the edges within the
radius. A shard is passed to the task that owns it instead of being broadcast, since the trees grow with the corpus.

A shard over TREE fingerprints (thousands of near copies) is dealt by hash into trees of about that size. Links within
each tree come first. What two such trees don't yet share is found in a second pass, in which the fingerprints outside
the shard's largest component are sent to all trees of the shard; inside the component no link can change anything.

Empty and null texts have fingerprint zero and are linked like any other. Repeated texts share a fingerprint and are
one point here. Null doc_ids get a fingerprint and the component of its other documents, but are never its id. Extra
columns are ignored. `one_of_each` goes by rows, not by ids: rows are told apart by doc_id and text together, so an id that
stands before several texts loses none of them, and of rows that have both in common one is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallbase.llm.common import components, cut, in_files, text_slices

#: Fingerprints in one tree, at most about.
TREE = 4096
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64 majority bits of the XXH64 (seed 42) of all runs of `shingle` words, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[-n:].tolist()
    first = [0, *(ends[: n - 1] + 1).tolist()]
    hashed = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(first, last, strict=True)), np.uint64, n)
    octets = hashed.astype(">u8").view(np.uint8).reshape(n, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, *keep: str) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and the columns `keep`, of text, of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            found = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found.view(np.int64)), *map(batch.column, keep)], names=["doc_id", "fp", *keep])

    return docs.select("doc_id", "text", *keep).mapInArrow(work, ", ".join(["doc_id long, fp long", *(f"{k} string" for k in keep)]))


class BKTree:
    """A BK-tree of integers from which found ones can be removed, so that each is found once."""

    def __init__(self, points: list[int]):
        self.points = points
        self.children: list[dict[int, int]] = [{} for _ in points]
        self.parent = [-1] * len(points)
        self.alive = [True] * len(points)
        self.below = [1] * len(points)  # points alive in the subtree
        for i in range(1, len(points)):
            at, p = 0, points[i]
            while True:
                d = (points[at] ^ p).bit_count()
                nxt = self.children[at].get(d)
                if nxt is None:
                    self.children[at][d], self.parent[i] = i, at
                    break
                at = nxt
            while at >= 0:
                self.below[at] += 1
                at = self.parent[at]

    def remove(self, i: int) -> None:
        self.alive[i] = False
        while i >= 0:
            self.below[i] -= 1
            i = self.parent[i]

    def search(self, p: int, radius: int) -> list[int]:
        """Indices of the points alive within the radius. Subtrees without any are not entered."""
        found, stack = [], [0] if self.points and self.below[0] else []
        while stack:
            at = stack.pop()
            d = (self.points[at] ^ p).bit_count()
            if d <= radius and self.alive[at]:
                found.append(at)
            below, kids = self.below, self.children[at]
            for e, kid in kids.items():
                if -radius <= e - d <= radius and below[kid]:
                    stack.append(kid)
        return found


def links_within(points: list[int], radius: int) -> list[tuple[int, int]]:
    """Pairs that connect every component of `points` under the radius: each point is reached once and then leaves the tree."""
    if len(points) == 2:
        return [(points[0], points[1])] if (points[0] ^ points[1]).bit_count() <= radius else []
    tree, out = BKTree(points), []
    for i in range(len(points)):
        if not tree.alive[i]:
            continue
        tree.remove(i)
        todo = [i]
        while todo and tree.below[0]:
            p = points[todo.pop()]
            for j in tree.search(p, radius):
                tree.remove(j)
                todo.append(j)
                out.append((points[i], points[j]))
    return out


def _masks(distinct: int, radius: int) -> list[int]:
    """Bit masks of the shards: the fewest blocks that leave about 64 unrelated fingerprints in a shard."""
    for agree in range(1, 64 - radius):
        blocks = radius + agree
        if distinct >> (64 * agree // blocks) <= 64 or agree == 4:
            break
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, agree)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _by_shard(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of each shard in rows sorted by (mask, part, tree). A shard may span batches."""
    held = None
    for batch in batches:
        rows = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("mask", "part", "tree", *names)]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        if not len(rows[0]):
            continue
        change = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0) | (np.diff(rows[2]) != 0)) + 1
        for a, b in zip([0, *change], change, strict=False):
            yield tuple(x[a:b] for x in rows[3:])
        last = change[-1] if len(change) else 0
        held = [x[last:] for x in rows]
    if held is not None:
        yield tuple(held[3:])


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], schema=_LINK)


def _dealt(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select("mask", "part", "tree", *columns).repartition("mask", "part", "tree").sortWithinPartitions("mask", "part", "tree", *columns)


def linked(points: DataFrame, radius: int = 4) -> DataFrame:
    """(fp, component) of distinct fingerprints: the smallest fp, as a signed long, that links of at most `radius` bits reach. Lone ones are left out."""
    n = points.count()
    masks = _masks(n, radius)
    keyed = points.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("mask", "part"))
    sizes = keyed.groupBy("mask", "part").agg(F.count("*").alias("n")).where("n > 1")
    keyed = cut(keyed.join(sizes, ["mask", "part"]).withColumn("trees", F.ceil(F.col("n") / F.lit(TREE)).cast("long")).withColumn("tree", F.pmod(F.xxhash64("fp", "mask"), "trees")), n * len(masks))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for (fp,) in _by_shard(batches, "fp"):
            if len(fp) > 1:
                out += links_within(fp.view(np.uint64).tolist(), radius)
            if len(out) > 50_000:
                yield _links(out)
                out = []
        yield _links(out)

    first = cut(_dealt(keyed, "fp").mapInArrow(within, "a long, b long").distinct(), n * len(masks))
    known = components(first)
    large = keyed.where("trees > 1")
    if large.limit(1).count() == 0:
        return known.select(F.col("id").alias("fp"), "component")
    placed = cut(large.join(known.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")), n * len(masks))
    heads = placed.groupBy("mask", "part", "component").agg(F.count("*").alias("n")).groupBy("mask", "part").agg(F.max_by("component", F.struct("n", "component")).alias("head"))
    asks = placed.join(heads, ["mask", "part"]).where("component <> head").select("mask", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("trees") - 1)).alias("tree"), "fp", F.lit(1).alias("asks"))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asks, fp in _by_shard(batches, "asks", "fp"):
            points = fp.view(np.uint64)
            tree = BKTree(points[asks == 0].tolist())
            found = [(p, tree.points[j]) for p in points[asks == 1].tolist() for j in tree.search(p, radius)]
            yield _links(found)

    rows = placed.select("mask", "part", "tree", "fp", F.lit(0).alias("asks")).unionByName(asks)
    second = _dealt(rows, "asks", "fp").mapInArrow(across, "a long, b long")
    return components(first.union(second)).select(F.col("id").alias("fp"), "component")


def _components(found: DataFrame, radius: int, least: Column) -> DataFrame:
    """fp, least, component of every fingerprint. least: what is kept of a fingerprint's rows."""
    points = cut(found.groupBy("fp").agg(least.alias("least")), found.count())
    return points.join(linked(points.select("fp"), radius), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def one_of_each(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """The rows of docs, one of each component: the one with the smallest doc_id (null comes last), then by checksum of its text.

    Only ids and checksums are grouped; texts move once, to meet the keys of the rows that go.
    """
    none = F.concat(F.when(F.col("doc_id").isNull(), "x").otherwise("i"), F.when(F.col("text").isNull(), "x").otherwise("t"))
    check = F.concat(none, F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))  # i, for rows with an id, stands before x
    keyed = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), check.alias("_check"))
    key = ["_id", "_check"]
    found = cut(fingerprints(docs.select("doc_id", "text", check.alias("_check")), shingle, "_check").select(F.coalesce("doc_id", F.lit(0)).alias("_id"), "_check", "fp"))
    first = F.min(F.struct(F.substring("_check", 1, 1).alias("none"), "_id", "_check"))
    kept = _components(found, radius, first).groupBy("component").agg(F.min("least").alias("k")).select("k._id", "k._check")
    keys = found.groupBy(*key).agg(F.count("*").alias("n"))
    marked = cut(keys.join(kept.withColumn("_kept", F.lit(True)), key, "left"), found.count())
    rest = keyed.join(marked.where("_kept is null").select(*key), key, "left_anti")
    again = marked.where("_kept and n > 1").select(*key)
    if not again.isEmpty():  # rows with id and text in common are combined where they are, before the shuffle
        rest = rest.join(again, key, "left_anti").unionByName(rest.join(again, key, "left_semi").groupBy(*key).agg(F.first("_row").alias("_row")).select("_row", *key))
    return rest.select("_row.*")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (the smallest doc_id that links reach, itself included) of every row."""
    found = cut(fingerprints(docs, shingle))
    joined = _components(found, radius, F.min("doc_id"))
    names = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = joined.join(names, "component").select("fp", "component_id")
    rows = in_files(found.join(named, "fp"), found.count())
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
