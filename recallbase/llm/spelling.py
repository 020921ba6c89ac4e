"""Spelling variants: words of one corpus that a single edit turns into one another, and the frequent form that each goes back to.

Two words are near if one inserted, deleted or replaced code point tells them apart. They are found by merging subtrees of
a trie. At a node where words part, the largest child is the heavy one. Every word of the lighter subtrees is put back
into the tree below the node with its next character skipped, replaced by the heavy one, or preceded by it, and into the
merged light subtrees with its next character left open; where it ends on the end of another word, the two are near. A pair
parts at one node only and is found there once. A word lies in a light subtree on log2(words) nodes of its path at most,
so the work is words times that, whatever the tree looks like.

No tree holds all words. Words that part after HEAD characters or later stand in the tree of their beginning; those that
part earlier have the end in common and stand in the tree of their last characters, read backwards. A tree is one group of
a task and has at most TREE words. A beginning that more words share is opened by a shuffle instead: its words are keyed
by position and by what is left of them without the character there, for each position up to twice the length of the
beginning, which is the same merging of subtrees for all nodes of that depth at once; words that part later go into trees of
a beginning twice as long, opened in turn if need be. A common end with too many words is opened at its first positions
and done. A group of such keys holds no more words than there are letters. So no group grows with the corpus and no pair
is lost.

Nulls and ties: a null text has no words; a null doc_id makes no deletions, its words count as they stand. Among near
words of equal count the smallest in code-point order is the form. Repeated rows count again. Extra columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallbase.llm.common import cut
from recallbase.operators.shared import small

#: Code points of a word, at least; occurrences, at least; times that a form is more frequent than its variant.
LEAST, OFTEN, RATIO = 7, 2, 10
#: Words of a tree, at most.
TREE = 50_000
#: Every SLIP-th occurrence, by checksum, loses a character.
SLIP = 31

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOUND = "word string, n_near long, best_n long, best string"


def vocabulary(docs: DataFrame, least: int = LEAST, often: int = OFTEN, slip: int | None = SLIP) -> DataFrame:
    """word, n: distinct words of the texts, of `least` code points and `often` occurrences. slip: with the deletions that stand for misspellings, None for the texts as they are."""
    runs = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(f"[a-zÀ-ÿ]{{{least},}}"), F.lit(0))
    words = docs.select("doc_id", F.explode(runs).alias("word"))
    if slip:
        h = F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("word")).cast("binary"))
        at = F.col("_h") % F.length("word")
        less = F.concat(F.col("word").substr(F.lit(1), at.cast("int")), F.col("word").substr((at + 2).cast("int"), F.length("word")))
        words = words.withColumn("_h", F.when(F.col("doc_id").isNotNull(), h)).withColumn("word", F.when(F.col("_h") % slip == 0, less).otherwise(F.col("word")))
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


def merged(words: list[str]) -> Iterator[tuple[int, int]]:
    """All pairs of places of near words in a sorted list of distinct words, each once."""
    ends = {w: i for i, w in enumerate(words)}
    nodes = [(0, len(words), 0)]
    while nodes:
        lo, hi, depth = nodes.pop()
        if hi - lo < 2:
            continue
        a, b = words[lo], words[hi - 1]
        while depth < len(a) and a[depth] == b[depth]:
            depth += 1
        path, x = a[:depth], lo
        if len(a) == depth:
            x += 1
        children = []
        while x < hi:
            y = bisect_left(words, path + chr(ord(words[x][depth]) + 1), x, hi)
            children.append((x, y, depth + 1))
            x = y
        nodes += children
        heavy = max(children, key=lambda c: c[1] - c[0])
        by_heavy = path + words[heavy[0]][depth]
        if len(a) == depth and by_heavy in ends:
            yield lo, ends[by_heavy]
        light: dict[str, list[int]] = {}
        for child in children:
            if child is heavy:
                continue
            for i in range(child[0], child[1]):
                rest = words[i][depth + 1 :]
                for other in (by_heavy + rest, by_heavy + words[i][depth:]):
                    if other in ends:
                        yield i, ends[other]
                if rest[:1] != words[i][depth] and path + rest in ends:  # else the two part further down
                    yield i, ends[path + rest]
                same = light.setdefault(rest, [])
                for j in same:
                    yield j, i
                same.append(i)


def _trees(batches: Iterator[pa.RecordBatch], head: int) -> Iterator[pa.RecordBatch]:
    """The near words of each tree's words. Batches hold the rows of a tree one after the other: back, key, word, n."""

    def answer(back: bool, rows: list[tuple[str, int]]) -> pa.RecordBatch | None:
        rows.sort()
        words, n, near, best = [r[0] for r in rows], [r[1] for r in rows], [0] * len(rows), [None] * len(rows)
        read = [w[::-1] for w in words] if back else words
        order = sorted(range(len(read)), key=read.__getitem__) if back else range(len(read))
        for i, j in merged([read[k] for k in order]):
            i, j = order[i], order[j]
            if back and words[i][:head] == words[j][:head]:
                continue  # in the tree of their beginning
            for x, y in ((i, j), (j, i)):
                near[x] += 1
                if best[x] is None or (-n[y], words[y]) < (-n[best[x]], words[best[x]]):
                    best[x] = y
        some = [i for i, k in enumerate(near) if k]
        if not some:
            return None
        return pa.RecordBatch.from_arrays([pa.array([words[i] for i in some]), pa.array([near[i] for i in some], pa.int64()), pa.array([n[best[i]] for i in some], pa.int64()), pa.array([words[best[i]] for i in some])], names=["word", "n_near", "best_n", "best"])

    tree, held = None, []
    for batch in batches:
        for back, key, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (back, key) != tree:
                if len(held) > 1 and (out := answer(tree[0], held)):
                    yield out
                tree, held = (back, key), []
            held.append((word, n))
    if len(held) > 1 and (out := answer(tree[0], held)):
        yield out


def _opened(words: DataFrame, first: int, end: int) -> DataFrame:
    """The near words that part at a position from `first` to before `end`, by keys in place of trees."""
    length = F.length("word")
    without = F.concat(F.col("word").substr(F.lit(1), F.col("_at")), F.col("word").substr(F.col("_at") + 2, length))
    keyed = words.select("word", "n", F.explode(F.sequence(F.lit(first), F.least(F.lit(end - 1), length))).alias("_at"))
    less = keyed.where(F.col("_at") < length).select(without.alias("key"), "_at", F.struct((-F.col("n")).alias("n"), "word", F.lit(True).alias("cut"), (F.substring("word", F.col("_at") + 1, F.lit(1)) != F.substring("word", F.col("_at") + 2, F.lit(1))).alias("here")).alias("m"))
    whole = keyed.select(F.col("word").alias("key"), "_at", F.struct((-F.col("n")).alias("n"), "word", F.lit(False).alias("cut"), F.lit(False).alias("here")).alias("m"))
    groups = less.unionByName(whole).groupBy("_at", "key").agg(F.array_sort(F.collect_list("m")).alias("all")).where(F.size("all") > 1)  # a word for each letter and one whole word, at most
    met = groups.select("all", F.explode("all").alias("m")).select(
        F.col("m.word").alias("word"),
        F.filter("all", lambda x: (x["word"] != F.col("m.word")) & ((x["cut"] & F.col("m.cut")) | (x["here"] & ~F.col("m.cut")) | (F.col("m.here") & ~x["cut"]))).alias("near"),
    )
    return met.where(F.size("near") > 0).select("word", F.size("near").cast("long").alias("n_near"), (-F.col("near")[0]["n"]).alias("best_n"), F.col("near")[0]["word"].alias("best"))


def _by_size(words: DataFrame, key: Column, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The words with their key where at most `most` share it, and the others, None if there are none."""
    keyed = words.select(key.alias("key"), "word", "n")
    many = cut(keyed.groupBy("key").agg(F.count("*").alias("_many")).where(F.col("_many") > most).select("key"), 0)
    if many.isEmpty():
        return keyed, None
    many = small(many)
    return keyed.join(many, "key", "left_anti"), cut(keyed.join(many, "key", "left_semi").select("word", "n"))


def near_words(words: DataFrame, least: int = LEAST, tree: int = TREE) -> DataFrame:
    """word, n_near, best_n, best: how many words are near, and the most frequent of them, of every word that has one. words: word (distinct, of at least `least` code points), n."""
    head = least // 2
    trees, found, rest, p = [], [], words, head
    while rest is not None:
        few, many = _by_size(rest, F.substring("word", 1, p), tree)
        trees.append(few.select(F.lit(False).alias("back"), "key", "word", "n"))
        if many is not None:
            found.append(_opened(many, p, 2 * p))
        rest, p = many, 2 * p
    few, many = _by_size(words, F.expr(f"right(word, {least - head})"), tree)
    trees.append(few.select(F.lit(True).alias("back"), "key", "word", "n"))
    if many is not None:
        found.append(_opened(many, 0, head))
    dealt = reduce(DataFrame.unionByName, trees).repartition("back", "key").sortWithinPartitions("back", "key")
    found.append(dealt.mapInArrow(lambda batches: _trees(batches, head), _FOUND))
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return reduce(DataFrame.unionByName, found).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last of the forms that a word's form leads to. forms: word, form. Counts grow tenfold with each step, so the paths, halved in each round, end soon."""
    held = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = held.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = cut(held.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        held = step.select("word", "root")
        if step.where("_moved").isEmpty():
            return held


def variants(docs: DataFrame, least: int = LEAST, often: int = OFTEN, ratio: int = RATIO, slip: int | None = SLIP, tree: int = TREE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts."""
    words = cut(vocabulary(docs, least, often, slip))
    near = cut(near_words(words, least, tree))
    known = F.col("best_n") >= ratio * F.col("n")
    named = cut(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(known, F.col("best")).alias("form"), F.when(known, F.col("best_n")).alias("form_n")))
    last = roots(named.where("form is not null"))
    return named.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
