"""Best-fit packing with swap-based local search.

Documents become pieces of at most `size` ids. Rows of lengths, without ids, are dealt into chunks of bounded size. Each
chunk is packed best fit, longest first; then documents of the least filled sequence are exchanged one for one or two for
one with, or moved to, others that have room. Each step raises the sum of squared fills, so the search ends, and a
sequence whose documents all found a place is gone. Sequences that stay below REPACK of the size are dealt and packed
once more together, so the count of half-empty sequences does not grow with the number of chunks.

Nulls and ties: a null text counts as empty (its only id is the end id); null and repeated doc_ids are packed as any
other row; equal lengths keep their order. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallbase.llm.common import cut, text_slices
from recallbase.llm.tokens import encoder

#: Pieces in a chunk, at most about; one chunk is one task's work and a few MB.
CHUNK = 32_768
#: Sequences filled below this share are packed once more.
REPACK = 0.97


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 4096, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every document, without a shuffle."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, end = encoder(tokenizer, False), np.array([end_id], np.uint32)
        for batch in text_slices(batches, "text"):
            rows: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32") + ("ids",) * with_ids}
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tool.encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                ids = np.concatenate([ids, end])
                for k, a in enumerate(range(0, len(ids), size)):
                    part = ids[a : a + size]
                    for name, v in zip(rows, (doc_id, k, a, len(part), zlib.crc32(part.astype("<u4").tobytes()), part.astype(np.int32)), strict=False):
                        rows[name].append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(rows.values(), kinds, strict=False)], names=list(rows))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(encode, schema)


class Bins:
    """Sequences of one chunk: items[b] lists (length, item) in ascending order, fill[b] their sum.

    Two indices answer a step without looking at the other bins. `tightest` finds the bin with the least room for a document.
    `_partner` finds what to take back for a gift: a bin of room r that holds a document of length x is entered under r + x,
    and it can swap x for a longer gift g if g <= r + x; the step raises the squared fill if r + x < g + size - fill of
    the giver. So the least x in a range of r + x is asked for, of a tree of minima.
    """

    def __init__(self, size: int):
        self.size, self.items, self.fill = size, [], []
        self.room: list[list[int]] = [[] for _ in range(size + 1)]
        self.open = 0  # bit r: room[r] names a bin that may have room r
        self.free = 0  # room in all bins that aren't empty
        self.version: list[int] = []  # entries of an older version are void
        self.entries: list[list[tuple[int, int, int]]] = []
        self.least: list[int] = []

    def _note(self, b: int) -> None:
        r = self.size - self.fill[b]
        if r:
            self.room[r].append(b)
            self.open |= 1 << r

    def tightest(self, length: int, but: int = -1) -> int:
        """The bin with the least room that holds `length` more, or -1."""
        above = self.open >> length << length
        while above:
            r = (above & -above).bit_length() - 1
            stack = self.room[r]
            while stack and (self.size - self.fill[stack[-1]] != r or not self.items[stack[-1]]):
                stack.pop()
            found = next((b for b in reversed(stack) if b != but and self.size - self.fill[b] == r), -1) if stack else -1
            if not stack:
                self.open &= ~(1 << r)
            if found >= 0:
                return found
            above &= above - 1
        return -1

    def put(self, b: int, x: tuple[int, int]) -> None:
        self.free += (0 if self.items[b] else self.size) - x[0]
        bisect.insort(self.items[b], x)
        self.fill[b] += x[0]
        self._note(b)

    def take(self, b: int, x: tuple[int, int]) -> None:
        self.items[b].remove(x)
        self.fill[b] -= x[0]
        self.free += x[0] - (0 if self.items[b] else self.size)
        self._note(b)

    def fit(self, lengths: np.ndarray) -> None:
        """Best fit, longest first."""
        for i in np.argsort(-lengths, kind="stable").tolist():
            x = (int(lengths[i]), i)
            b = self.tightest(x[0])
            if b < 0:
                b = len(self.items)
                self.items.append([])
                self.fill.append(0)
            self.put(b, x)

    def _enter(self, b: int) -> None:
        """A new version of the bin in the index."""
        self.version[b] += 1
        r = self.size - self.fill[b]
        for length in {x[0] for x in self.items[b]} if r else ():
            heapq.heappush(self.entries[r + length], (length, b, self.version[b]))
            self._lower(r + length, length)

    def _lower(self, k: int, value: int) -> None:
        at = k + len(self.least) // 2
        while at and self.least[at] > value:
            self.least[at] = value
            at >>= 1

    def _refresh(self, k: int) -> int:
        """The least length under k that is still true; the tree is told."""
        heap = self.entries[k]
        while heap and self.version[heap[0][1]] != heap[0][2]:
            heapq.heappop(heap)
        value = heap[0][0] if heap else self.size + 1
        at = k + len(self.least) // 2
        if self.least[at] != value:
            self.least[at] = value
            at >>= 1
            while at:
                value = min(self.least[2 * at], self.least[2 * at + 1])
                if self.least[at] == value:
                    break
                self.least[at] = value
                at >>= 1
        return self.least[k + len(self.least) // 2]

    def _partner(self, total: int, giver: int) -> tuple[int, int] | None:
        """(bin, length) of the shortest document to take for a gift of length `total`."""
        half = len(self.least) // 2
        lo, hi = total + half, min(total + self.size - self.fill[giver], 2 * self.size + 1) + half
        nodes = []
        while lo < hi:
            if lo & 1:
                nodes.append(lo)
                lo += 1
            if hi & 1:
                hi -= 1
                nodes.append(hi)
            lo, hi = lo >> 1, hi >> 1
        while nodes:
            at = min(nodes, key=self.least.__getitem__)
            value = self.least[at]
            if value >= total:
                return None
            while at < half:
                at = 2 * at if self.least[2 * at] == value else 2 * at + 1
            if self._refresh(at - half) == value:
                return self.entries[at - half][0][1], value
        return None

    def empty_least(self) -> None:
        """Works on the least filled bin until it is empty or no step helps, then on the next; ends when the room left elsewhere can't hold it."""
        n = len(self.items)
        self.version, self.entries, self.least = [0] * n, [[] for _ in range(2 * self.size + 1)], [self.size + 1] * (2 << (2 * self.size + 1).bit_length())
        todo = [(f, b) for b, f in enumerate(self.fill) if 0 < f < self.size]
        heapq.heapify(todo)
        for _, b in todo:
            self._enter(b)
        stuck = [False] * n
        while todo:
            fill, target = heapq.heappop(todo)
            if stuck[target] or fill != self.fill[target] or not 0 < fill < self.size:
                continue
            if self.free - (self.size - fill) < fill:
                return
            self.version[target] += 1  # not its own partner
            while self.items[target]:
                b = self._step(target)
                if b < 0:
                    break
                self._enter(b)
                if not stuck[b]:
                    heapq.heappush(todo, (self.fill[b], b))
            if self.items[target]:
                stuck[target] = True
                self._enter(target)

    @staticmethod
    def _gifts(own: list[tuple[int, int]]) -> Iterator[tuple[int, tuple[tuple[int, int], ...]]]:
        """What a sequence can give: (length, documents), each document and then each pair, once for each length that comes of it."""
        kinds: dict[int, list[tuple[int, int]]] = {}
        for x in reversed(own):
            kinds.setdefault(x[0], []).append(x)
        yield from ((length, (same[0],)) for length, same in kinds.items())
        told, lengths = set(), list(kinds)[::-1]
        for i, a in enumerate(lengths):
            for b in lengths[i:]:
                if a + b not in told and (a != b or len(kinds[a]) > 1):
                    told.add(a + b)
                    yield a + b, (kinds[a][0], kinds[b][-1])

    def _step(self, target: int) -> int:
        """The bin that a document of the target was moved to or exchanged with, or -1."""
        own = self.items[target]
        for x in reversed(own):
            b = self.tightest(x[0], but=target)
            if b >= 0 and self.fill[b] + x[0] > self.fill[target]:
                self.take(target, x)
                self.put(b, x)
                return b
        for total, given in self._gifts(own):
            found = self._partner(total, target)
            if found:
                b, length = found
                back = self.items[b][bisect.bisect_left(self.items[b], (length, -1))]
                self.take(b, back)
                for x in given:
                    self.take(target, x)
                    self.put(b, x)
                self.put(target, back)
                return b
        return -1


def pack_lengths(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every item: bins gapless from 0, offsets gapless from 0 in each bin."""
    bins = Bins(size)
    bins.fit(lengths)
    bins.empty_least()
    at, offset, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for items in bins.items:
        if items:
            place = 0
            for length, i in reversed(items):
                at[i], offset[i] = n, place
                place += length
            n += 1
    return at, offset


def _pack_round(rows: DataFrame, size: int, first: int) -> DataFrame:
    """Deals rows evenly over chunks, whatever their keys, and packs each. sequence_id starts at `first`."""
    held = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
    chunks = max(1, -(-held.count() // CHUNK))

    def pack(part: pa.Table) -> pa.Table:
        part = part.sort_by("_row")
        lengths = part["length"].to_numpy()
        at, offset = pack_lengths(lengths, size)
        fill = np.bincount(at, lengths).astype(np.int64)[at]
        number = first + (part["_chunk"][0].as_py() << 32)
        for name, column in (("sequence_id", at + number), ("offset", offset), ("fill", fill)):
            part = part.append_column(name, pa.array(column))
        return part

    names = [f"{f.name} {f.dataType.simpleString()}" for f in held.schema.fields] + ["_chunk long", "sequence_id long", "offset long", "fill long"]
    return held.withColumn("_chunk", F.pmod(F.xxhash64("_row"), F.lit(chunks))).groupBy("_chunk").applyInArrow(pack, ", ".join(names)).drop("_chunk", "_row")


def pack(rows: DataFrame, size: int = 4096) -> DataFrame:
    """rows (with a column length of 1 to size) plus sequence_id and offset."""
    done = cut(_pack_round(rows, size, 0))
    loose = done.where(F.col("fill") < REPACK * size).drop("sequence_id", "offset", "fill")
    again = _pack_round(loose, size, 1 << 62)
    return done.where(F.col("fill") >= REPACK * size).drop("fill").unionByName(again.drop("fill"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(pieces(docs, tokenizer, end_id, size), size).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str, end_id: int = 1, size: int = 4096) -> DataFrame:
    """The packed ids themselves: sequence_id and ids, a row per sequence of at most `size` ids. doc_id must be a key of docs."""
    parts = pieces(docs, tokenizer, end_id, size, with_ids=True).select("doc_id", "piece", "ids")
    return (
        packed.select("doc_id", "piece", "sequence_id", "offset").join(parts, ["doc_id", "piece"])
        .groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
    )
