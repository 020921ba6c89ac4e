"""Hybrid scores of all documents for many queries at once, where the documents lie.

What queries ask for is written down once as numbers: their words, the words of the vocabulary that are like one, the phrases that
one covers. Every task reads that and scores its documents a few at a time, all queries together, and keeps the k best of each query;
only these are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallbase.functions import text as T
from recallbase.operators.shared import new_folder

#: Numbers in a table of documents (or chunks) and terms (or queries) that a task holds at once.
CELLS = 2_000_000
PARTS = ("semantic", "title", "lexical", "keyword", "category")


def seed_of(*words: DataFrame) -> int:
    """The first seed by which no two rows of a table (one column of distinct values) have the same hash of 64 bits."""
    sizes, seed = [w.count() for w in words], 0
    while any(w.select(F.xxhash64(w.columns[0], F.lit(seed))).distinct().count() < n for w, n in zip(words, sizes, strict=True)):
        seed += 1
    return seed


def write_asked(queries: DataFrame, matches: DataFrame, phrases: DataFrame, categories: DataFrame | None, seed: int) -> str:
    """A new folder with queries (query_id, head, terms, head_terms, parts: arrays of words), matches (term, token, similarity), phrases and categories (query_id, phrase or category_id, value), in which words are hashes."""
    folder, key = new_folder(queries.sparkSession, "asked"), lambda x: F.xxhash64(x, F.lit(seed))
    each = lambda name: F.transform(name, key).alias(name)
    queries.select("query_id", "head", each("terms"), each("head_terms"), F.transform("parts", lambda p: F.transform(p, key)).alias("parts")).write.parquet(f"{folder}/queries")
    matches.select(key("token").alias("h"), key("term").alias("term"), (F.col("term") == F.col("token")).alias("same"), F.col("similarity").cast("double").alias("value")).write.parquet(f"{folder}/words")
    for rows, column in ((phrases, "phrase"), (categories, "category_id")):
        if rows is not None:
            rows.select(key(F.col(column).cast("string")).alias("h"), "query_id", F.col("value").cast("double").alias("value")).write.parquet(f"{folder}/{column}")
    return folder


class Groups(NamedTuple):
    """Columns of numbers in groups: those of group i stand from start[i] to start[i + 1]."""

    start: np.ndarray
    columns: tuple[np.ndarray, ...]

    @classmethod
    def of(cls, group: np.ndarray, n: int, *columns: np.ndarray) -> Groups:
        order = np.argsort(group, kind="stable")
        return cls(np.searchsorted(group[order], np.arange(n + 1)), tuple(c[order] for c in columns))

    def of_each(self, groups: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place among groups, *columns) of all members of the groups, one group after the other."""
        n = self.start[groups + 1] - self.start[groups]
        which = np.repeat(np.arange(len(groups)), n)
        at = np.arange(len(which)) + np.repeat(self.start[groups] - (np.cumsum(n) - n), n)
        return which, *(c[at] for c in self.columns)


class Keyed(NamedTuple):
    """Groups by hashes."""

    hashes: np.ndarray
    groups: Groups

    @classmethod
    def of(cls, h: np.ndarray, *columns: np.ndarray) -> Keyed:
        hashes, group = np.unique(h, return_inverse=True)
        return cls(hashes, Groups.of(group, len(hashes), *columns))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among h, group) of those that are there."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        there = np.flatnonzero(self.hashes[at] == h)
        return there, at[there]


class Terms(NamedTuple):
    """Words of queries: by term (query, times); how many words a query has, with repeats and without."""

    by_term: Groups
    all: np.ndarray
    distinct: np.ndarray


class Asked(NamedTuple):
    ids: pa.Array
    heads: list[str]
    n_terms: int
    words: Keyed  # (term, similarity)
    own: np.ndarray  # which term a word is itself, or -1
    text: Terms
    head: Terms
    parts: Groups  # by term (part)
    part_sizes: np.ndarray
    with_parts: np.ndarray  # queries, and where the parts of each begin
    first_part: np.ndarray
    phrases: Keyed  # (query, value)
    categories: Keyed


def _table(folder: str) -> pa.Table | None:
    files, top = pafs.FileSystem.from_uri(folder)
    found = files.get_file_info(pafs.FileSelector(top, allow_not_found=True))
    tables = []
    for name in sorted(f.path for f in found if f.base_name.endswith(".parquet")):
        with files.open_input_file(name) as stream:
            tables.append(pq.ParquetFile(stream).read())
    return pa.concat_tables(tables).combine_chunks() if tables else None


def lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """(lengths, members) of lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), column.flatten()


@lru_cache(maxsize=1)
def asked(folder: str) -> Asked:
    """What write_asked wrote; a worker keeps it from task to task."""
    q, w = _table(f"{folder}/queries"), _table(f"{folder}/words")
    n = q.num_rows
    held = {name: lists(q[name]) for name in ("terms", "head_terms", "parts")}
    part_sizes, part_terms = lists(held["parts"][1])
    told = {"terms": held["terms"][1].to_numpy(), "head_terms": held["head_terms"][1].to_numpy(), "parts": part_terms.to_numpy()}
    terms = np.unique(np.concatenate(list(told.values())))
    h, same, value = (w[name].to_numpy() for name in ("h", "same", "value"))
    term = np.searchsorted(terms, w["term"].to_numpy())
    words = Keyed.of(h, term.astype(np.int32), value)
    own = np.full(len(words.hashes), -1)
    own[np.searchsorted(words.hashes, h[same])] = term[same]

    def of_text(name: str) -> Terms:
        sizes, found = held[name][0], np.searchsorted(terms, told[name])
        pairs, times = np.unique(np.repeat(np.arange(n), sizes) * len(terms) + found, return_counts=True)
        query, term = np.divmod(pairs, max(1, len(terms)))
        return Terms(Groups.of(term, len(terms), query, times.astype(np.float64)), sizes, np.bincount(query, minlength=n))

    def by_query(name: str) -> Keyed:
        rows = _table(f"{folder}/{name}")
        if rows is None:
            return Keyed.of(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return Keyed.of(rows["h"].to_numpy(), pc.index_in(rows["query_id"], value_set=q["query_id"].combine_chunks()).to_numpy(), rows["value"].to_numpy())

    parts = Groups.of(np.searchsorted(terms, told["parts"]), len(terms), np.repeat(np.arange(len(part_sizes)), part_sizes))
    with_parts = np.flatnonzero(held["parts"][0])
    first_part = (np.cumsum(held["parts"][0]) - held["parts"][0])[with_parts]
    ids = q["query_id"].combine_chunks()
    return Asked(ids, q["head"].to_pylist(), len(terms), words, own, of_text("terms"), of_text("head_terms"), parts, part_sizes, with_parts, first_part, by_query("phrase"), by_query("category_id"))


def f1(common: np.ndarray, asked_sizes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """F1 of sets (rows) of given sizes and those of queries (columns), by how many words they share."""
    p, r = common / np.maximum(asked_sizes, 1), common / np.maximum(sizes, 1)[:, None]
    return 2 * p * r / np.where(common > 0, p + r, 1)


def alike(a: Asked, terms: Terms, row: np.ndarray, word: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coverage of each query's terms, F1 of sets) by sets (rows) of words, given by those that are like a term (row, word), each once, and the sets' sizes."""
    n, q, width = len(sizes), len(a.ids), a.n_terms
    which, term, value = a.words.groups.of_each(word)
    best = np.zeros(n * width)
    np.maximum.at(best, row[which] * width + term, value)
    there = np.flatnonzero(best)
    which, query, times = terms.by_term.of_each(there % width)
    total = np.bincount((there // width)[which] * q + query, best[there][which] * times, n * q).reshape(n, q)
    own = a.own[word]
    which, query, _ = terms.by_term.of_each(own[own >= 0])
    common = np.bincount(row[own >= 0][which] * q + query, minlength=n * q).reshape(n, q)
    return np.minimum(1.0, total / np.maximum(terms.all, 1)), f1(common, terms.distinct, sizes)


def of_chunks(a: Asked, chunk: np.ndarray, word: np.ndarray, sizes: np.ndarray, of_doc: np.ndarray) -> np.ndarray:
    """The best F1 of a chunk of each document (rows) and a part of each query. of_doc: the number of chunks of each document."""
    out, parts = np.zeros((len(of_doc), len(a.ids))), len(a.part_sizes)
    docs = np.flatnonzero(of_doc)
    if len(docs) and parts:
        own = a.own[word]
        which, part = a.parts.of_each(own[own >= 0])
        common = np.bincount(chunk[own >= 0][which] * parts + part, minlength=len(sizes) * parts).reshape(len(sizes), parts)
        best = np.maximum.reduceat(f1(common, a.part_sizes, sizes), (np.cumsum(of_doc) - of_doc)[docs], axis=0)
        out[np.ix_(docs, a.with_parts)] = np.maximum.reduceat(best, a.first_part, axis=1)
    return out


class Names:
    """Tells the queries whose first line holds a title, or lies within it."""

    def __init__(self, heads: list[str]):
        self.heads, self.all = heads, "\n".join(heads)
        self.words = {w for h in heads for w in h.split(" ")}
        self.by_length = sorted((len(h), i) for i, h in enumerate(heads))

    def of(self, title: str | None) -> list[int]:
        if title is None:
            return []
        inner = title.split(" ", 2)
        found = [i for i, h in enumerate(self.heads) if title in h] if (len(inner) < 3 or inner[1] in self.words) and title in self.all else []
        for n, i in self.by_length:
            if n >= len(title):
                break
            if self.heads[i] in title:
                found.append(i)
        return found


def best_of(rows: pa.Table, k: int) -> pa.Table:
    """The k best rows of each query (q): by score, title, and the least id."""
    rows = rows.sort_by([("q", "ascending"), ("score", "descending"), ("title", "descending"), ("id", "ascending")])
    q = rows["q"].to_numpy()
    return rows.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < k))


def scan(folder: str, docs: DataFrame, k: int, weights: tuple[float, ...], words: int, over: int, seed: int) -> DataFrame:
    """query_id, id, the five parts and score of the k best documents of each task, for each query of the folder. docs: (id, title, text, keywords, categories)."""

    def scored(a: Asked, names: Names, batch: pa.RecordBatch) -> Iterator[tuple[int, int, dict[str, np.ndarray], np.ndarray]]:
        """(first document, one behind the last, parts, scores, those that share anything with a query as 0 or more, others below) of a few documents after the other."""
        q, titles = len(a.ids), batch["t"].to_pylist()
        size, (title_n, title_h), (of_doc, chunks) = batch["nd"].to_numpy(), lists(batch["title"]), lists(batch["chunks"])
        chunk_n, chunk_h = lists(chunks)
        first = np.concatenate([[0], np.cumsum(of_doc)])
        at, word = a.words.find(chunk_h.to_numpy())
        chunk = np.repeat(np.arange(len(chunk_n)), chunk_n)[at]
        doc = np.repeat(np.arange(len(of_doc)), of_doc)[chunk]
        at, t_word = a.words.find(title_h.to_numpy())
        t_doc = np.repeat(np.arange(len(title_n)), title_n)[at]
        more = {}
        for name, keyed in (("keyword", a.phrases), ("category", a.categories)):
            n, h = lists(batch[name])
            at, group = keyed.find(h.to_numpy())
            which, query, value = keyed.groups.of_each(group)
            more[name] = np.repeat(np.arange(len(n)), n)[at][which], query, value
        lo = 0
        while lo < len(size):
            hi = min(len(size), lo + max(1, CELLS // max(a.n_terms, q, 1)))
            hi = max(lo + 1, min(hi, int(np.searchsorted(first, first[lo] + CELLS // max(1, len(a.part_sizes)), "right")) - 1))
            here, there = slice(*np.searchsorted(doc, (lo, hi))), slice(*np.searchsorted(t_doc, (lo, hi)))
            v = {"semantic": of_chunks(a, chunk[here] - first[lo], word[here], chunk_n[first[lo] : first[hi]], of_doc[lo:hi])}
            cover, same = alike(a, a.head, t_doc[there] - lo, t_word[there], title_n[lo:hi])
            v["title"] = np.maximum(cover, same)
            for i, t in enumerate(titles[lo:hi]):
                if found := names.of(t):
                    v["title"][i, found] = 1.0
            width = max(1, len(a.words.hashes))
            each = np.unique(np.concatenate([(doc[here] - lo) * width + word[here], (t_doc[there] - lo) * width + t_word[there]]))
            v["lexical"] = np.maximum(np.maximum(*alike(a, a.text, each // width, each % width, size[lo:hi])), cover)
            for name, (row, query, value) in more.items():
                mine = slice(*np.searchsorted(row, (lo, hi)))
                v[name] = np.zeros((hi - lo, q))
                np.maximum.at(v[name], (row[mine] - lo, query[mine]), value[mine])
            v["lexical"] = np.maximum(v["lexical"], v["keyword"])
            total, there_weights, any_part = np.zeros((hi - lo, q)), np.zeros((hi - lo, q)), np.zeros((hi - lo, q), bool)
            titled = np.array([t is not None for t in titles[lo:hi]])[:, None]
            for name, weight in zip(PARTS, weights, strict=True):
                any_part |= v[name] > 0
                if weight > 0:
                    on = {"semantic": np.ones((1, 1), bool), "title": titled}.get(name, v[name] > 0)
                    total += np.where(on, v[name] * weight, 0.0)
                    there_weights += np.where(on, weight, 0.0)
            score = np.clip(total / np.where(there_weights > 0, there_weights, 1.0), 0.0, 1.0)
            yield lo, hi, v, np.where(any_part, score, -1.0)
            lo = hi

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = asked(folder)
        names, best = Names(a.heads), None
        least = np.zeros(len(a.ids))  # what a document needs to be among the k best of those before
        for batch in batches:
            for lo, hi, v, score in scored(a, names, batch):
                edge = np.partition(score, hi - lo - k, axis=0)[hi - lo - k] if hi - lo > k else least
                row, q = np.nonzero(score >= np.maximum(np.maximum(least, edge), 0.0))
                if not len(row):
                    continue
                found = pa.table({"q": q, "id": batch["id"].take(pa.array(row + lo)), **{p: v[p][row, q] for p in PARTS}, "score": score[row, q]})
                best = best_of(found if best is None else pa.concat_tables([best, found]).combine_chunks(), k)
                q = best["q"].to_numpy()
                full = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) == k - 1)
                least[q[full]] = best["score"].to_numpy()[full]
        if best is not None:
            best = best.combine_chunks()
            yield from best.add_column(0, "query_id", a.ids.take(best["q"].combine_chunks())).drop_columns("q").to_batches()

    def hashed(words: Column) -> Column:
        return F.transform(words, lambda x: F.xxhash64(x, F.lit(seed)))

    def given(name: str) -> Column:
        return hashed(F.coalesce(F.filter(F.col(name).cast("array<string>"), lambda x: x.isNotNull()), T.strings()))

    titled = F.trim(F.coalesce("title", F.lit(""))) != ""
    told = docs.where("id is not null").select("id", F.when(titled, T.normalized(F.col("title"))).alias("t"), T.tokens(F.col("title")).alias("title"), F.transform(T.chunk_words(F.col("text"), words, over), T.tokens).alias("chunks"), given("keywords").alias("keyword"), given("categories").alias("category"))
    size = F.size(F.array_distinct(F.concat("title", F.flatten("chunks"))))  # no token reaches across two chunks' words
    rows = told.select("id", "t", size.alias("nd"), hashed(F.col("title")).alias("title"), F.transform("chunks", hashed).alias("chunks"), "keyword", "category")
    return rows.mapInArrow(work, f"query_id {_asked_type(docs, folder)}, id {docs.schema['id'].dataType.simpleString()}, " + ", ".join(f"{p} double" for p in (*PARTS, "score")))


def _asked_type(docs: DataFrame, folder: str) -> str:
    return docs.sparkSession.read.parquet(f"{folder}/queries").schema["query_id"].dataType.simpleString()
