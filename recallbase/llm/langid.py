"""Language identification by unigram piece models, with all segmentations of a word summed.

The pieces are the byte strings of a public vocabulary and all single bytes. Each language has a probability per piece.
The probability of a word (lower-cased UTF-8, with the space before it) is the sum over its segmentations into pieces of
the product of their probabilities, by the forward algorithm; that of a text is the product over its words. The piece
probabilities are fitted by expectation maximisation: expected counts of pieces over all segmentations, from the forward
and backward sums. Long words, such as sentences of scripts without spaces, are taken apart where no piece of theirs
reaches across: every segmentation has a border there, so the sum of the whole is the product of the sums of the parts.

Training: word counts of at most SAMPLE different texts a language, those with the smallest hash of doc_id and text; of a
longer text the first SAMPLE_CHARS characters. Scoring covers every row and the whole of each text. The model has a column
per language that occurs, so lang should be a label of few values.

Nulls and ties: null texts and texts without a letter (Unicode category L) are `und` with score 0; so is everything when
no language was learned. Equal scores go to the language first in order. Repeated rows are scored each, and learned from
once. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallbase.llm.common import Rows, WordMemo, hashed_share, in_fold, segments, text_slices

#: Bound of the training sample: texts of a language, and characters of a text.
SAMPLE, SAMPLE_CHARS = 400, 20_000
#: Words of more bytes are taken apart where they can be; bytes of words that are looked at together.
PART, CELLS = 48, 60_000
_SLOTS = 20
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def load_pieces(path: str) -> list[bytes]:
    """Pieces of a vocabulary file of base64 tokens and ranks, a token a line, and the single bytes."""
    with open(path, "rb") as lines:
        tokens = {base64.b64decode(line.split()[0]) for line in lines if line.strip()}
    return sorted((tokens - {b""}) | {bytes([b]) for b in range(256)})


def _longer(key: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """The 64-bit key of strings a byte longer."""
    return (key ^ (key >> np.uint64(32))) * _STEP + byte + np.uint64(1)


class PieceIndex:
    """Byte strings -> piece number, for whole arrays, by a 64-bit key that differs for all pieces. Strings that are no piece get the number of pieces."""

    def __init__(self, pieces: list[bytes]):
        self.n, self.longest = len(pieces), max(map(len, pieces))
        keys = np.zeros(self.n, np.uint64)
        sizes = np.fromiter(map(len, pieces), np.int64, self.n)
        for k in range(self.longest):
            on = np.flatnonzero(sizes > k)
            keys[on] = _longer(keys[on], np.fromiter((pieces[i][k] for i in on.tolist()), np.uint64, len(on)))
        if len(np.unique(keys)) < self.n or not keys.all():
            raise ValueError("two pieces have one key")
        self.key = np.zeros(1 << _SLOTS, np.uint64)
        self.value = np.full(1 << _SLOTS, self.n, np.int32)
        todo = np.arange(self.n)
        slot = self._slot(keys)
        while len(todo):
            free = self.key[slot[todo]] == 0
            place, first = np.unique(np.where(free, slot[todo], -1), return_index=True)
            put = todo[first[place >= 0]]
            self.key[slot[put]], self.value[slot[put]] = keys[put], put
            todo = np.setdiff1d(todo, put)
            slot[todo] = (slot[todo] + 1) & ((1 << _SLOTS) - 1)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        shape, keys = keys.shape, keys.ravel()
        slot = self._slot(keys)
        held = self.key[slot]
        out = np.where(held == keys, self.value[slot], self.n)
        open_ = np.flatnonzero((held != keys) & (held != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << _SLOTS) - 1)
            held = self.key[slot[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.value[slot[open_[hit]]]
            open_ = open_[~hit & (held != 0)]
        return out.reshape(shape)

    def starts(self, grid: np.ndarray) -> np.ndarray:
        """(bytes, lengths, rows): the piece of each length that begins at each byte of the rows of the grid."""
        rows, n = grid.shape
        out = np.full((n, min(self.longest, n), rows), self.n, np.int32)
        grid = grid.astype(np.uint64)
        key = _longer(np.zeros_like(grid), grid)
        for k in range(out.shape[1]):
            if k:
                key = _longer(key[:, :-1], grid[:, k:])
            out[: n - k, k] = self.find(key).T
        return out


def _cuts(raw: bytes, index: PieceIndex) -> list[bytes]:
    """A word as parts of PART bytes or more, parted only where none of its pieces reaches across."""
    reach = np.zeros(len(raw) + 1, np.int64)
    step = CELLS // index.longest
    for a in range(0, len(raw), step):  # pieces that begin in this stretch
        found = index.starts(np.frombuffer(raw, np.uint8)[None, a : a + step + index.longest])[:step, :, 0]
        at, k = np.nonzero(found != index.n)
        np.add.at(reach, a + at + 1, 1)
        np.add.at(reach, a + at + k + 1, -1)
    free = np.flatnonzero(np.cumsum(reach)[:-1] == 0)
    parts, last = [], 0
    for place in free[free > 0].tolist():
        if place - last >= PART:
            parts.append(raw[last:place])
            last = place
    return [*parts, raw[last:]]


def _parts(words: list[str], index: PieceIndex) -> tuple[list[bytes], np.ndarray]:
    """Byte parts of the words, and the word of each part."""
    parts, owner = [], []
    for i, w in enumerate(words):
        raw = b" " + w.encode()
        for part in [raw] if len(raw) <= PART else _cuts(raw, index):
            parts.append(part)
            owner.append(i)
    return parts, np.array(owner, np.int64)


def _grids(parts: list[bytes], index: PieceIndex) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts of equal length together: their rows, and the pieces that begin at each byte."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    order = np.argsort(sizes, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        if len(rows):
            n = int(sizes[rows[0]])
            step = max(1, CELLS // n)
            for a in range(0, len(rows), step):
                some = rows[a : a + step]
                yield some, index.starts(np.frombuffer(b"".join([parts[i] for i in some.tolist()]), np.uint8).reshape(len(some), n))


def _sums(logs: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Logs of the sums over the first axis of exp(logs) * prob."""
    top = logs.max(0)
    return top + np.log((np.exp(logs - top) * prob).sum(0))


def _forward(found: np.ndarray, prob: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Logs of the forward sums (bytes + 1, rows, languages). before: those of the first places."""
    n, longest, rows = found.shape
    logs, known = np.zeros((n + 1, rows, prob.shape[1])), 1
    if before is not None:
        known = len(before)
        logs[:known] = before
    for j in range(known, n + 1):
        m = min(longest, j)
        back, sizes = np.arange(j - 1, j - 1 - m, -1), np.arange(m)
        logs[j] = _sums(logs[back], prob[found[back, sizes]])
    return logs


def _stretches(raw: bytes, index: PieceIndex, prob: np.ndarray) -> np.ndarray:
    """Log probability of one long part, a stretch at a time."""
    logs = np.zeros((1, 1, prob.shape[1]))
    for a in range(0, len(raw), CELLS):
        back = len(logs) - 1
        logs = _forward(index.starts(np.frombuffer(raw, np.uint8)[None, a - back : a + CELLS]), prob, logs)[-index.longest - 1 :]
    return logs[-1, 0]


def word_scores(words: list[str], index: PieceIndex, prob: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language."""
    parts, owner = _parts(words, index)
    out = np.zeros((len(words), prob.shape[1]))
    for i, part in enumerate(parts):
        if len(part) > CELLS:
            out[owner[i]] += _stretches(part, index, prob)
    short = np.flatnonzero([len(part) <= CELLS for part in parts])
    for rows, found in _grids([parts[i] for i in short.tolist()], index):
        np.add.at(out, owner[short[rows]], _forward(found, prob)[-1])
    return out


def _expected(words: list[str], counts: np.ndarray, index: PieceIndex, prob: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece by each language, over all segmentations. counts: (words, languages)."""
    parts, owner = _parts(words, index)
    out = np.zeros_like(prob)
    for rows, found in _grids(parts, index):
        n, longest, _ = found.shape
        ahead = _forward(found, prob)
        behind = np.zeros_like(ahead)
        used = np.zeros((*found.shape, prob.shape[1]))
        for i in range(n - 1, -1, -1):
            m = min(longest, n - i)
            here = prob[found[i, :m]]
            behind[i] = _sums(behind[i + 1 : i + m + 1], here)
            used[i, :m] = np.exp(ahead[i] + behind[i + 1 : i + m + 1] - ahead[n]) * here * counts[owner[rows]]
        for lang in range(prob.shape[1]):
            out[:, lang] += np.bincount(found.ravel(), used[..., lang].ravel(), len(out))
    out[index.n] = 0
    return out


@dataclass
class Model:
    langs: list[str]
    pieces: list[bytes]
    prob: np.ndarray  # (pieces + 1, languages), the last row is 0


def train(counts: dict[str, Counter], pieces: list[bytes], rounds: int = 4) -> Model:
    """Piece probabilities per language from word counts per language."""
    langs, index = sorted(counts), PieceIndex(pieces)
    words = sorted(set().union(*counts.values()))
    table = np.array([[counts[c][w] for c in langs] for w in words], np.float64).reshape(len(words), len(langs))
    prob = np.zeros((index.n + 1, len(langs)))
    prob[: index.n] = 1 / index.n
    for _ in range(rounds):
        used = _expected(words, table, index, prob) + 0.05
        used[index.n] = 0
        prob = used / used.sum(0)
    return Model(langs, pieces, prob)


def fit(docs: DataFrame, pieces: list[bytes], fold_of: int = 4, held_fold: int = 2) -> Model | None:
    """The model from texts with a language outside the held fold; None if there are none."""
    usable = docs.where((in_fold("doc_id", fold_of) != held_fold) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", hashed_share("doc_id", "text").alias("_order"))
    sizes = usable.groupBy("lang").agg(F.count("*").alias("_rows"), F.min("_order").alias("_least"))
    # Thinned by hash to about twice the sample before texts are shuffled. sizes: a row per language, of which the model holds a column each.
    few = usable.join(F.broadcast(sizes), "lang").where((F.col("_order") * F.col("_rows") <= 2.0 * SAMPLE) | (F.col("_order") == F.col("_least")))
    few = few.groupBy("lang", "_order").agg(F.min(F.substring("text", 1, SAMPLE_CHARS)).alias("text"))  # equal rows become one before they move
    near = Window.partitionBy("lang").orderBy("_order", "text")
    few = few.withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= SAMPLE)

    def learn(part: pa.Table) -> pa.Table:
        counts: dict[str, Counter] = {}
        for lang, text in zip(part["lang"].to_pylist(), part["text"].to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(text.lower().split())
        counts = {k: v for k, v in sorted(counts.items()) if v}
        return pa.table({"model": [pickle.dumps(train(counts, pieces))] if counts else pa.array([], pa.binary())})

    made = few.select("lang", "text").groupBy().applyInArrow(learn, "model binary").first()  # the sample in one task, the model to the driver
    return pickle.loads(made.model) if made else None


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of every row, without a shuffle. score: the share of the best language in the probability of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of pieces times the number of languages

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if model is not None:
            index, table = PieceIndex(model.pieces), Rows(len(model.langs), dtype=np.float32)

            def learn(words: list[str], fresh: bool) -> None:
                if fresh:
                    table.clear()
                if words:
                    table.add(word_scores(words, index, model.prob))

            memo = WordMemo(learn)
        for batch in text_slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            told = [model is not None and t is not None and any(map(str.isalpha, t)) for t in texts]
            lists = [t.lower().split() if ok else [] for t, ok in zip(texts, told, strict=True)]
            best, sure = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            words = [w for ws in lists for w in ws]
            if words:
                sizes = np.array([len(ws) for ws in lists])
                full = np.flatnonzero(sizes)
                rows = memo.rows(words)
                total = np.add.reduceat(table.data[rows].astype(np.float64), segments(sizes[full])[:-1])
                share = np.exp(total - total.max(1, keepdims=True))
                best[full], sure[full] = total.argmax(1), share.max(1) / share.sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([model.langs[b] if ok else "und" for b, ok in zip(best.tolist(), told, strict=True)], pa.string()), pa.array(sure)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, vocabulary: str, fold_of: int = 4, held_fold: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs, learned from the rows outside the held fold."""
    scored = score(docs, fit(docs, load_pieces(vocabulary), fold_of, held_fold))
    return scored.select("doc_id", F.coalesce(in_fold("doc_id", fold_of) == held_fold, F.lit(False)).alias("held_out"), "lang_pred", "score")
