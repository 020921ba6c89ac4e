"""What several operators share: Arrow slices, word memos, folds; lineage cuts and connected components are the library's."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from recallbase.operators.graph import components
from recallbase.operators.shared import cut, in_files, new_folder

__all__ = ["Rows", "WordMemo", "components", "cut", "hashed_share", "in_files", "in_fold", "ragged", "segments", "shared_dir", "text_slices"]

#: Bytes of text that Python looks at together. An Arrow batch can hold ten thousand long texts; words of all of them at once would not fit.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share."""
    return new_folder(spark, "corpus")


def text_slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `limit` bytes of text, at least a row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = np.cumsum(sizes) // limit
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, b - a)


class WordMemo(dict):
    """Word -> row number. `fill` is called with the words not met before and stores their rows; past `limit` words it starts anew, so its memory is bounded."""

    def __init__(self, fill: Callable[[list[str], bool], None], limit: int = 500_000):
        super().__init__()
        self.fill, self.limit, self.pending = fill, limit, []

    def __missing__(self, word: str) -> int:
        self.pending.append(word)
        i = self[word] = len(self)
        return i

    def rows(self, words: list[str]) -> np.ndarray:
        fresh = len(self) == 0
        if len(self) > self.limit:
            self.clear()
            fresh = True
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.pending or fresh:
            todo, self.pending = self.pending, []
            self.fill(todo, fresh)
        return out


class Rows:
    """A growing numpy table to which WordMemo.fill adds."""

    def __init__(self, *shape: int, dtype=np.float64):
        self.data, self.n = np.zeros((1024, *shape), dtype), 0

    def clear(self) -> None:
        self.n = 0

    def add(self, new: np.ndarray) -> None:
        need = self.n + len(new)
        if need > len(self.data):
            grown = np.zeros((max(need, 2 * len(self.data)), *self.data.shape[1:]), self.data.dtype)
            grown[: self.n] = self.data[: self.n]
            self.data = grown
        self.data[self.n : need] = new
        self.n = need


def segments(lengths: np.ndarray) -> np.ndarray:
    """Start of each of the runs with these lengths, and the end."""
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + lengths[i] - 1, for all i in turn."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - lengths - starts, lengths)


def in_fold(doc_id, folds: int):
    """crc32 of doc_id as text, modulo folds. Null ids fall into no fold (null)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(folds)


def hashed_share(*columns) -> Column:
    """A number from 0 to 1 by hash of the columns, to thin rows alike wherever they stand."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double")) / F.lit(float(1 << 53))
