"""Benchmark decontamination: rare n-gram seeds find test items in documents, Smith-Waterman alignment scores them.

Words are runs of letters, digits and non-ASCII characters of the lower-cased text. Seeds are pairs of neighbouring
words of an item. An alignment of n item words that scores `least` or more has lost at most 2 n (1 - least) pairs: a
word put in costs 1 of 2 n and breaks one pair, a word changed or left out costs 3 and breaks two. What is left (`_needed`)
lies within n (3 - 2 least) words of the document. So a part of a document is aligned with an item where it holds that
many seeds so close together, and no alignment that scores `least` is missed, however the copy was edited and whatever
else the corpus holds. Items too short for a pair to be sure to remain take their single words as seeds, likewise. Of
the pairs counted over the whole corpus the commonest are left out, as many as the count leaves room for (SPARE).
The score is divided by that of a full match.

The items are the query set. They are read in blocks of at most BLOCK_WORDS words, and each block meets all documents
in a scan of its own, in which only counts of n-grams are shuffled. So what a task holds of them is bounded, and no
document is moved.

Nulls and ties: null and empty texts match nothing, on either side; neither do items
without words. Text in scripts without spaces is one word up to the next blank or mark, so of such items only whole runs
are found. Each row is looked at alone, so repeated documents give repeated rows and repeated items a row each.
Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallbase.llm.common import text_slices

#: Seeds that must lie together where an item has as many, the commonest beyond are left out; words of items in a block; seed hits looked at together.
SPARE, BLOCK_WORDS, HITS = 3, 1_000_000, 2_000_000
#: Alignment: score of an equal word, of an unequal pair, of a word left out.
SAME, OTHER, GAP = 2.0, -1.0, -1.0
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_BASE = 0x9E3779B97F4A7C15


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts in turn, and where each text's words begin (with the end)."""
    texts = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _WORD[raw]
    begin = inside[1:-1] & ~inside[:-2]
    begin[offsets[:-1][offsets[:-1] < len(raw)]] |= inside[1:-1][offsets[:-1][offsets[:-1] < len(raw)]]
    starts = np.flatnonzero(begin)
    # A word's hash is a sum of its bytes times powers of a base by place in the word, by running sums over the word.
    held = np.where(inside[1:-1], raw, 0).astype(np.uint64)
    here = np.arange(len(raw))
    place = here - np.maximum.accumulate(np.where(begin, here, 0)) if len(raw) else here
    powers = _powers(int(place.max()) + 1 if len(place) else 1)
    words = np.add.reduceat((held + np.uint64(1)) * powers[place] * inside[1:-1], starts) if len(starts) else np.zeros(0, np.uint64)
    words ^= words >> np.uint64(31)
    words *= np.uint64(0xBF58476D1CE4E5B9)
    return words, np.searchsorted(starts, offsets)


def _powers(n: int) -> np.ndarray:
    """Powers 1, 2, .. of the base, modulo 2^64."""
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, _BASE, np.uint64))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that begins at each word; the last n - 1 words have none."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - n + 1 + k]
        out ^= out >> np.uint64(29)
    return out


class Lookup:
    """Is a hash among these, and which? A bit table answers most of the time, a binary search the rest."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.keys >> np.uint64(42)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in `hashes` that are keys, and the numbers of their keys."""
        at = np.flatnonzero(self.bits[hashes >> np.uint64(42)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        k = np.searchsorted(self.keys, hashes[at])
        k[k == len(self.keys)] = 0
        real = self.keys[k] == hashes[at]
        return at[real], k[real]


def align(item: np.ndarray, part: np.ndarray) -> tuple[float, int]:
    """Best local alignment of two word sequences: score, and the end in `part`. A row of the table at a time; gaps along a row by a running maximum."""
    steps = -GAP * np.arange(1, len(part) + 1)
    above = np.zeros(len(part) + 1)
    best, end = 0.0, 0
    for w in item:
        fresh = np.maximum(above[:-1] + np.where(part == w, SAME, OTHER), above[1:] + GAP)
        np.maximum(fresh, 0, out=fresh)
        row = np.maximum.accumulate(fresh + steps) - steps
        above = np.concatenate([[0.0], row])
        k = int(row.argmax())
        if row[k] > best:
            best, end = float(row[k]), k + 1
    return best, end


def _needed(n: int, least: float) -> tuple[int, int]:
    """Words of a seed of an item of n words, and how many of its seeds every alignment that scores `least` keeps."""
    pairs = n - 1 - math.floor(2 * n * (1 - least) + 1e-9)
    return (2, pairs) if pairs > 0 else (1, max(1, n - math.floor(n * (1 - least) + 1e-9)))


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Items as word hashes, in blocks."""
    block, held = [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        words = hashed_words(pa.array([row.text]))[0]
        if not len(words):
            continue
        if held and held + len(words) > BLOCK_WORDS:
            yield block
            block, held = [], 0
        block.append((row.item_id, words))
        held += len(words)
    if block:
        yield block


def _counts(docs: DataFrame, keys: dict[int, np.ndarray]) -> dict[tuple[int, int], int]:
    """How often the block's n-grams, by their number of words, occur in all documents."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = {size: Lookup(k) for size, k in keys.items()}
        totals = {size: np.zeros(len(x.keys), np.int64) for size, x in lookups.items()}
        for batch in text_slices(batches, "text"):
            words, begins = hashed_words(batch.column("text"))
            for size, lookup in lookups.items():
                at, key = lookup.find(grams(words, size))
                within = at + size <= begins[np.searchsorted(begins, at, side="right")]  # no n-gram across two documents
                totals[size] += np.bincount(key[within], minlength=len(lookup.keys))
        for size, total in totals.items():
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), size, np.int32)), pa.array(lookups[size].keys[seen].view(np.int64)), pa.array(total[seen])], names=["size", "h", "n"])

    rows = docs.select("text").mapInArrow(scan, "size int, h long, n long").groupBy("size", "h").agg(F.sum("n").alias("n"))
    return {(r["size"], int(r.h) & (1 << 64) - 1): r.n for r in rows.toLocalIterator()}


class Seeds:
    """Seeds of one number of words: finds the parts of documents that hold enough seeds of an item."""

    def __init__(self, size: int, items: list[np.ndarray], owners: list[int], counts: dict[tuple[int, int], int], least: float):
        self.size = size
        self.asked, self.reach = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
        pairs = set()
        for k in owners:
            own, n = grams(items[k], size).tolist(), len(items[k])
            keep = _needed(n, least)[1]
            self.asked[k] = asked = max(min(keep, SPARE), (keep + 1) // 2)
            self.reach[k] = math.floor(n * (3 - 2 * least) + 1e-9)
            rare = sorted(range(len(own)), key=lambda i: (counts.get((size, own[i]), 0), own[i], i))
            pairs |= {(own[i], k) for i in rare[: len(own) - keep + asked]}
        h, k = zip(*sorted(pairs), strict=True)
        self.hashes, self.owners = np.array(h, np.uint64), np.array(k, np.int64)

    def open(self) -> None:
        self.lookup = Lookup(self.hashes)
        self.first = np.searchsorted(self.hashes, self.lookup.keys)
        self.count = np.diff(np.append(self.first, len(self.hashes)))

    def parts(self, words: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, first word, end word) of the parts that may hold an alignment."""
        at, key = self.lookup.find(grams(words, self.size))
        doc = np.searchsorted(begins, at, side="right") - 1
        whole = at + self.size <= begins[doc + 1]  # no n-gram across two documents
        at, key, doc = at[whole], key[whole], doc[whole]
        each = self.count[key]
        starts = np.flatnonzero(np.diff(doc, prepend=-1))
        edges = starts[1:][np.diff((np.cumsum(each) - each)[starts] // HITS) != 0]
        for a, b in zip([0, *edges], [*edges, len(at)], strict=True):
            yield from self._together(at[a:b], key[a:b], doc[a:b], begins)

    def _together(self, at: np.ndarray, key: np.ndarray, doc: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        each = self.count[key]
        item = self.owners[np.repeat(self.first[key] - np.cumsum(each) + each, each) + np.arange(each.sum())]
        at, doc = np.repeat(at, each), np.repeat(doc, each)
        order = np.lexsort((at, item, doc))
        at, item, doc = at[order], item[order], doc[order]
        last = np.arange(len(at)) + self.asked[item] - 1
        j = np.flatnonzero(last < len(at))
        last = last[j]
        j = j[(item[last] == item[j]) & (doc[last] == doc[j]) & (at[last] - at[j] <= self.reach[item[j]] - self.size)]
        if not len(j):
            return
        last = j + self.asked[item[j]] - 1
        lo = np.maximum(at[last] + self.size - self.reach[item[j]], begins[doc[j]]) - begins[doc[j]]
        hi = np.minimum(at[j] + self.reach[item[j]], begins[doc[j] + 1]) - begins[doc[j]]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(item[j]) != 0) | (np.diff(doc[j]) != 0) | (lo[1:] > hi[:-1])]))
        end = np.append(new[1:], len(j)) - 1
        yield from zip(doc[j][new].tolist(), item[j][new].tolist(), lo[new].tolist(), hi[end].tolist(), strict=True)


class Matcher:
    """A block of items with its seeds: finds the items that texts hold copies of."""

    def __init__(self, docs: DataFrame, block: list[tuple[int, np.ndarray]], least: float):
        self.ids, self.items, self.least = [i for i, _ in block], [w for _, w in block], least
        by_size: dict[int, list[int]] = {}
        for k, words in enumerate(self.items):
            by_size.setdefault(_needed(len(words), least)[0], []).append(k)
        counts = _counts(docs, {size: np.concatenate([grams(self.items[k], size) for k in owners]) for size, owners in by_size.items()})
        self.seeds = [Seeds(size, self.items, owners, counts, least) for size, owners in by_size.items()]

    def open(self) -> Matcher:
        """With the look-up tables that a task needs."""
        for seeds in self.seeds:
            seeds.open()
        return self

    def find(self, texts: pa.Array) -> Iterator[tuple[int, int, float, int, int]]:
        """(row, item_id, score, first word, end word) of the best alignment of each text and item that scores `least` or more."""
        words, begins = hashed_words(texts)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for seeds in self.seeds:
            for d, k, lo, hi in seeds.parts(words, begins):
                known = best.get((d, k), (0.0,))[0]
                if known == 1.0:
                    continue
                item, part = self.items[k], words[begins[d] + lo : begins[d] + hi]
                score, end = align(item, part)
                share = score / (SAME * len(item))
                if share >= self.least and share > known:
                    best[d, k] = (share, lo + end - align(item[::-1], part[:end][::-1])[1], lo + end)
        for (d, k), found in sorted(best.items()):
            yield d, self.ids[k], *found


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.6) -> DataFrame:
    """doc_id, item_id, score (0 to 1), first_word, end_word for each document and item whose best alignment scores `least` or more."""
    found = []
    for block in _blocks(benchmark):
        matcher = Matcher(docs, block, least)

        def scan(batches: Iterator[pa.RecordBatch], matcher=matcher) -> Iterator[pa.RecordBatch]:
            m = matcher.open()
            for batch in text_slices(batches, "text"):
                doc_ids = batch.column("doc_id")
                rows = [(doc_ids[d].as_py(), *rest) for d, *rest in m.find(batch.column("text"))]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "score", "first_word", "end_word"])

        found.append(docs.select("doc_id", "text").mapInArrow(scan, _SCHEMA))
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], _SCHEMA)


_SCHEMA = "doc_id long, item_id long, score double, first_word long, end_word long"


def clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.6) -> DataFrame:
    """docs without the rows found. Each row is judged by its own text, where it is; no text is shuffled."""
    out = docs
    for block in _blocks(benchmark):
        matcher = Matcher(docs, block, least)

        def scan(batches: Iterator[pa.RecordBatch], matcher=matcher) -> Iterator[pa.RecordBatch]:
            m = matcher.open()
            for batch in text_slices(batches, "text"):
                keep = np.ones(batch.num_rows, bool)
                keep[[found[0] for found in m.find(batch.column("text"))]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(scan, docs.schema)
    return out
