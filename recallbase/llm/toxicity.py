"""Toxicity: bags of subwords, embedded, averaged and fed to a linear softmax; both layers are trained together in numpy.

A word's subwords are the byte n-grams of 3 to 5 of the lower-cased word between boundary marks, and the word itself,
hashed into a fixed number of rows. Unseen misspellings share most n-grams with the word they misspell. A text is read in
windows of WORDS words, since a few words among thousands would vanish in one average; its score is that of its worst
window, through a logistic curve fitted on the training texts. For a window the two layers come down to a sum of one
number per subword, so a word needs two numbers (sum and count), which workers remember.

Training: the worst window of a text speaks for it, so first all windows carry the label of their text, then toxic texts
are held by their worst windows only. It runs in one task, on at most SAMPLE labelled documents of each label, those with
the smallest hash of doc_id: texts of at most SAMPLE_CHARS characters, and where these are too few, the first SAMPLE_CHARS
characters of longer ones. Scoring covers every row and the whole of each text.

Nulls and ties: null and empty texts have one empty window, whose score is that of no evidence; null labels, labels
without a document and documents without a word are not learned from; a doc_id that is labelled again alike counts once,
one with both labels twice, and of several documents with one doc_id the shorter kind, then the smallest text is learned
from. Without documents of both labels to learn from, every score is 0. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallbase.llm.common import Rows, WordMemo, hashed_share, in_fold, ragged, segments, text_slices

#: Bound of the training sample: documents of a label, and characters of a document.
SAMPLE, SAMPLE_CHARS = 2_000, 20_000
#: Rows of the embedding, its width, words of a window, n-gram sizes.
BUCKETS, WIDTH, WORDS, SIZES = 1 << 17, 8, 8, (3, 4, 5)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of the subwords of all words in turn, and how many each word has."""
    raws = [b"<" + w.encode() + b">" for w in words]
    sizes = np.fromiter(map(len, raws), np.int64, len(raws))
    data = np.frombuffer(b"".join(raws), np.uint8).astype(np.uint64)
    starts = segments(sizes)[:-1]
    counts = sum((np.maximum(sizes - n + 1, 0) for n in SIZES), np.ones(len(raws), np.int64))
    first = segments(counts)[:-1]
    out = np.empty(int(counts.sum()), np.int64)
    at = first.copy()
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    for n in SIZES:
        each = np.maximum(sizes - n + 1, 0)
        where = ragged(starts, each)
        h = np.full(len(where), n, np.uint64)
        for k in range(n):
            h = (h ^ data[where + k]) * _MULT
            h ^= h >> np.uint64(29)
        out[ragged(at, each)] = ((h * _MULT) >> shift).astype(np.int64)
        at += each
    if len(raws):
        place = np.arange(len(data)) - np.repeat(starts, sizes)
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(int(sizes.max()), _MULT, np.uint64))
            whole = np.add.reduceat(data * powers[place], starts)
            out[at] = (((whole ^ (whole >> np.uint64(31))) * _MULT) >> shift).astype(np.int64)
    return out, counts


def words_of(text: str | None) -> list[str]:
    """Lower-cased words; a run of one word counts once, or it would fill a window with itself."""
    words = (text or "").lower().split()
    return [w for w, before in zip(words, ["", *words], strict=False) if w != before]


def windows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the windows over n words: half of one apart, the last ends with the text."""
    starts = np.arange(0, max(1, n - WORDS // 2), WORDS // 2)
    return starts, np.minimum(starts + WORDS, n)


@dataclass
class Model:
    """weight: per subword row, what it adds to the log odds of an average. bias, and the curve from the worst window to a score."""

    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.shift, -60, 60)))


def _worst(sums: np.ndarray, counts: np.ndarray, n_words: list[int], bias: float) -> tuple[np.ndarray, list[int]]:
    """Largest log odds among each text's windows, and which window has it."""
    total, number = np.concatenate([[0], np.cumsum(sums)]), np.concatenate([[0], np.cumsum(counts)])
    out, which, base = np.full(len(n_words), bias), [0] * len(n_words), 0
    for i, n in enumerate(n_words):
        if n:
            a, b = windows(n)
            odds = (total[base + b] - total[base + a]) / (number[base + b] - number[base + a])
            which[i] = int(odds.argmax())
            out[i] += odds[which[i]]
            base += n
    return out, which


def train(texts: Iterable[str | None], labels: np.ndarray, epochs: int = 5, rate: float = 0.5) -> Model | None:
    """Fits embedding and softmax by Adagrad over windows, in a fixed order. Texts without words are left out; None where no text of one of the labels is left."""
    known: dict[str, int] = {}
    rows, kept = [], []
    for text, label in zip(texts, labels.tolist(), strict=True):  # words are numbered as they come, so that no list of them all is held
        words = words_of(text)
        if words:
            rows.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
            kept.append(label)
    labels = np.array(kept, np.int64)
    if len(set(kept)) < 2:
        return None
    sub, per_word = subwords(list(known))
    known.clear()
    sub_at = segments(per_word)[:-1]
    rng = np.random.default_rng(7)
    emb = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    out = rng.uniform(-1, 1, (WIDTH, 2)).astype(np.float32)
    b = np.zeros(2, np.float32)
    g_emb, g_out, g_b = np.full((BUCKETS, 1), 1e-6, np.float32), np.full_like(out, 1e-6), np.full_like(b, 1e-6)
    n_words = [len(r) for r in rows]
    flat = np.concatenate(rows)
    base = segments(np.array(n_words))[:-1]
    spans = [(windows(n)[0] + s, windows(n)[1] + s, np.full(len(windows(n)[0]), y)) for n, s, y in zip(n_words, base, labels, strict=True)]
    all_windows = tuple(np.concatenate(x) for x in zip(*spans, strict=True))
    clean = all_windows[2] == 0
    for epoch in range(epochs):
        if epoch < 2:
            chosen = all_windows
        else:  # toxic texts by their two worst windows
            word_sum = np.add.reduceat((emb @ (out[:, 1] - out[:, 0]))[sub], sub_at)
            total, number = np.concatenate([[0], np.cumsum(word_sum[flat])]), np.concatenate([[0], np.cumsum(per_word[flat])])
            parts = []
            for n, s, y in zip(n_words, base, labels, strict=True):
                if y:
                    a, e = windows(n)
                    odds = (total[s + e] - total[s + a]) / (number[s + e] - number[s + a])
                    top = np.argsort(-odds, kind="stable")[:2]
                    parts.append((a[top] + s, e[top] + s))
            pos = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
            chosen = tuple(np.concatenate([x[clean], p]) for x, p in zip(all_windows[:2], pos, strict=True)) + (np.concatenate([np.zeros(clean.sum(), np.int64), np.ones(len(pos[0]), np.int64)]),)
        order = rng.permutation(len(chosen[0]))
        share = chosen[2].mean()
        balance = np.where(chosen[2] == 1, min(20.0, 0.5 * (1 - share) / max(share, 1e-9)) if epoch >= 2 else 1.0, 1.0).astype(np.float32)
        for k in range(0, len(order), 4096):
            pick = order[k : k + 4096]
            a, e, y = chosen[0][pick], chosen[1][pick], chosen[2][pick]
            # Each distinct word of the batch is summed once, and its gradient spread over its subwords once.
            w, place = np.unique(flat[ragged(a, e - a)], return_inverse=True)
            rows_in, cuts = sub[ragged(sub_at[w], per_word[w])], segments(e - a)[:-1]
            of_word = np.add.reduceat(emb[rows_in], segments(per_word[w])[:-1])
            number = np.add.reduceat(per_word[w][place], cuts)
            mean = np.add.reduceat(of_word[place], cuts) / number[:, None].astype(np.float32)
            logits = mean @ out + b
            logits -= logits.max(1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= balance[pick][:, None]
            d_out, d_b = mean.T @ p, p.sum(0)
            d_mean = (p @ out.T) / number[:, None].astype(np.float32)
            spread, owner = np.repeat(np.arange(len(y)), e - a), np.repeat(np.arange(len(w)), per_word[w])
            d_word = np.stack([np.bincount(place, d_mean[spread, c], len(w)) for c in range(WIDTH)], 1)
            used, at = np.unique(rows_in, return_inverse=True)
            d_emb = np.stack([np.bincount(at, d_word[owner, c], len(used)) for c in range(WIDTH)], 1).astype(np.float32)
            g_emb[used] += (d_emb**2).mean(1, keepdims=True)
            emb[used] -= rate * d_emb / np.sqrt(g_emb[used])
            g_out += d_out**2
            out -= 0.1 * rate * d_out / np.sqrt(g_out)
            g_b += d_b**2
            b -= 0.1 * rate * d_b / np.sqrt(g_b)
    weight, bias = (emb @ (out[:, 1] - out[:, 0])).astype(np.float64), float(b[1] - b[0])
    word_sum = np.add.reduceat(weight[sub], sub_at)
    worst, _ = _worst(word_sum[flat], per_word[flat], n_words, bias)
    slope, shift = _curve(worst, labels)
    return Model(weight, bias, slope, shift)


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from x to y, by Newton's method; both kinds weigh the same."""
    mean, spread = float(x.mean()), float(x.std()) or 1.0
    z = np.stack([(x - mean) / spread, np.ones(len(x))], 1)
    weigh = np.where(y == 1, 1 / max(1, y.sum()), 1 / max(1, (1 - y).sum()))
    weigh *= len(y) / weigh.sum()
    beta = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -40, 40)))
        grad = z.T @ (weigh * (y - p)) - 0.01 * beta
        hess = (z * (weigh * p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(2)
        beta += np.linalg.solve(hess, grad)
    return float(beta[0] / spread), float(beta[1] - beta[0] * mean / spread)


_MODEL = "weight binary, bias double, slope double, shift double"


def sample(docs: DataFrame, labels: DataFrame, fold_of: int = 3, held_fold: int = 1) -> DataFrame:
    """_id, toxic, _order, text of the documents to learn from: labelled, outside the held fold, at most SAMPLE of each label."""
    usable = labels.where((in_fold("doc_id", fold_of) != held_fold) & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").alias("_id"), "toxic").agg(hashed_share("doc_id").alias("_order"))
    sizes = {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}  # two rows
    # About twice the sample of each label goes to all tasks as ids.
    share = F.when(F.col("toxic") == 1, min(1.0, 2.0 * SAMPLE / sizes.get(1, 1))).otherwise(min(1.0, 2.0 * SAMPLE / sizes.get(0, 1)))
    few = F.broadcast(usable.where(F.col("_order") <= share))
    least = F.min(F.struct((F.length("text") > SAMPLE_CHARS).alias("long"), F.substring("text", 1, SAMPLE_CHARS).alias("text"))).alias("t")
    rows = docs.select("doc_id", "text").where(F.col("text").rlike(r"\S")).join(few, F.col("doc_id") == F.col("_id")).groupBy("_id", "toxic", "_order").agg(least)
    near = Window.partitionBy("toxic").orderBy("t.long", "_order", "_id")
    return rows.withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= SAMPLE).select("_id", "toxic", "_order", "t.text")


def fit(docs: DataFrame, labels: DataFrame, fold_of: int = 3, held_fold: int = 1) -> Model | None:
    """The model from labelled rows outside the held fold; None if one of the two labels is missing. Learned in one task from the sample; the driver gets the weights."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        if table.num_rows:
            table = table.sort_by([("_order", "ascending"), ("_id", "ascending"), ("toxic", "ascending")])
            found = train((t.as_py() for t in table.column("text")), table.column("toxic").to_numpy().astype(np.int64))
            if found is not None:
                yield pa.RecordBatch.from_pydict({"weight": [found.weight.tobytes()], "bias": [found.bias], "slope": [found.slope], "shift": [found.shift]})

    drawn = sample(docs, labels, fold_of, held_fold).select("_id", F.col("toxic").cast("long").alias("toxic"), "_order", "text")
    found = drawn.repartition(1).mapInArrow(learn, _MODEL).collect()
    return Model(np.frombuffer(found[0].weight, np.float64), found[0].bias, found[0].slope, found[0].shift) if found else None


def _scorer(model: Model | None):
    """A function of texts -> scores that remembers the words it has met."""
    if model is None:
        return lambda texts: np.zeros(len(texts))
    table = Rows(2)

    def learn(words: list[str], fresh: bool) -> None:
        if fresh:
            table.clear()
        if words:
            sub, n = subwords(words)
            table.add(np.stack([np.add.reduceat(model.weight[sub], segments(n)[:-1]), n], 1))

    memo = WordMemo(learn)

    def scores(texts: list[str | None]) -> np.ndarray:
        lists = [words_of(t) for t in texts]
        rows = memo.rows([w for ws in lists for w in ws])  # may make the table grow
        values = table.data[rows]
        return model.score(_worst(values[:, 0], values[:, 1], [len(ws) for ws in lists], model.bias)[0])

    return scores


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score (0 to 1) of every row, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(shared.value)
        for batch in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(scores(batch.column("text").to_pylist()))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, score double")


def predict(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fold_of: int = 3, held_fold: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= threshold) of every row of docs."""
    scored = score(docs, fit(docs, labels, fold_of, held_fold))
    return scored.select("doc_id", F.coalesce(in_fold("doc_id", fold_of) == held_fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Rows of docs whose score is below the threshold. Each row is judged by its own text, where it is; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(shared.value)
        for batch in text_slices(batches, "text"):
            yield batch.filter(pa.array(scores(batch.column("text").to_pylist()) < threshold))

    return docs.mapInArrow(work, docs.schema)
