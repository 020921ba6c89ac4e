"""Quality rules whose thresholds follow the corpus: fences from quantile sketches per language and source, then a join.

Every text is measured in one scan without a shuffle. Texts that fail the base rules go. Of the others three rates, in whole
thousandths, are judged: code points a word, symbols a word, repeated lines a line. A sketch of a rate counts the values,
each cut to its BITS leading bits, so a quantile is right to one part in 2^(BITS - 1), a sketch has some thousands of
counters at most whatever it has seen, and two sketches merge by adding them up: partial sketches of tasks to those of
(language, source), these to those of languages and of all. A group's fences stand SPREADS times the distance of its quartiles
beyond them, and that distance counts as SLACK at least, so that a group of equal values doesn't reject all others. A
source with fewer than LEAST texts of a language takes the fences of the language, such a language those of all.

The fences come to the texts by a join. Groups with more than a thousandth of the rows are a thousand at most: they are
broadcast. The others are joined by a shuffle, where no key has more than a thousandth. Texts aren't shuffled at all.

Nulls and ties: a null text counts as empty, has no words and fails the base rules; a null lang or source is a value like any
other; repeated rows and null or repeated doc_ids are judged each for itself. Values on a fence are kept. Extra columns
are ignored by `judge` and kept by `keep_good`. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from recallbase.llm.common import cut, segments, text_slices

#: Words of a text at least; share of its words in repeated windows of WINDOW words at most, in percent.
WORDS, REPEATED, WINDOW = 50, 50, 3
#: Leading bits that a sketch keeps; texts of a group with fences of its own; distance of the fences.
BITS, LEAST, SPREADS = 7, 200, 3
#: Judged rates in thousandths, and the least distance of their quartiles.
SLACK = {"word_size": 500, "symbols": 50, "dup_lines": 200}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

_SPACE, _SYMBOL = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL[list(b"#*$%&|<>")] = True


def _repeated(words: list[bytes], n_words: np.ndarray) -> np.ndarray:
    """Of every text, its words in windows of WINDOW words that occur in it more than once. words: of all texts in turn."""
    texts, total = len(n_words), len(words)
    ids: dict[bytes, int] = defaultdict(itertools.count().__next__)
    key = np.fromiter(map(ids.__getitem__, words), np.int64, total)
    of = np.repeat(np.arange(texts), n_words)
    if total < WINDOW:
        return np.zeros(texts, np.int64)
    at = np.flatnonzero(of[: total - WINDOW + 1] == of[WINDOW - 1 :])  # windows within a text
    window = of[at]
    for k in range(WINDOW):  # numbers of beginnings, so that no product passes 64 bits
        _, window, times = np.unique(window * len(ids) + key[at + k], return_inverse=True, return_counts=True)
    twice = at[times[window] > 1]
    covered = np.zeros(total, bool)
    for k in range(WINDOW):
        covered[twice + k] = True
    return np.bincount(of[covered], minlength=texts)


def measured(texts: list[bytes]) -> dict[str, np.ndarray]:
    """COUNTS of UTF-8 texts."""
    n = len(texts)
    raw = np.frombuffer(b"\n".join(texts), np.uint8)  # the \n is in no word
    edges = segments(np.array([len(t) + 1 for t in texts], np.int64))[:-1]
    space = _SPACE[raw]
    begins = ~space & np.concatenate([[True], space[:-1]])

    def summed(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return np.diff(total[np.append(edges, len(raw))]) if n else np.zeros(0, np.int64)

    n_words = summed(begins)
    lines = [[x for x in t.split(b"\n") if x and not x.isspace()] for t in texts]
    return {
        "n_words": n_words,
        "word_chars": summed(~space & ((raw & 0xC0) != 0x80)),
        "n_symbols": summed(_SYMBOL[raw]),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": _repeated(b"\n".join(texts).split(), n_words),
        "n_lines": np.array([len(x) for x in lines], np.int64),
    }


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` and COUNTS of every text."""
    rows = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_text"))
    schema = StructType([rows.schema[c] for c in keep] + [StructField(c, LongType()) for c in COUNTS])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "_text"):
            found = measured(batch.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(found[c], pa.int64()) for c in COUNTS], names=[*keep, *COUNTS])

    return rows.mapInArrow(count, schema)


def rates() -> dict[str, Column]:
    """The judged rates of a measured text with words, in whole thousandths."""
    return {
        "word_size": F.expr("1000 * word_chars div n_words"),
        "symbols": F.expr("1000 * n_symbols div n_words"),
        "dup_lines": F.expr("1000 * n_dup_lines div n_lines"),
    }


def sketches(rows: DataFrame, names: list[str], by: list[str], bits: int = BITS) -> DataFrame:
    """*by, rate, value, n: the counters of the sketches of these columns of whole numbers from 0 up, null for none."""
    value = F.expr(f"CASE WHEN v < {1 << bits} THEN v ELSE (v >> (length(bin(v)) - {bits})) << (length(bin(v)) - {bits}) END")
    each = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("rate"), F.col(c).alias("v")) for c in names])).alias("r")).select(*by, "r.rate", "r.v").where("v is not null")
    return each.groupBy(*by, "rate", value.alias("value")).agg(F.count("*").alias("n"))


def merge(parts: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of larger groups from those of their parts."""
    return parts.groupBy(*by, "rate", "value").agg(F.sum("n").alias("n"))


def fences(counters: DataFrame, by: list[str], slack: dict[str, int], spreads: int = SPREADS) -> DataFrame:
    """*by, _texts and, for every rate, lo_ and hi_. The window of a sketch has its counters alone."""
    one = Window.partitionBy(*by, "rate")
    ranked = counters.withColumn("_to", F.sum("n").over(one.orderBy("value"))).withColumn("_all", F.sum("n").over(one))
    quartiles = ranked.groupBy(*by, "rate").agg(
        F.max("_all").alias("_texts"),
        F.min(F.when(4 * F.col("_to") >= F.col("_all"), F.col("value"))).alias("q1"),
        F.min(F.when(4 * F.col("_to") >= 3 * F.col("_all"), F.col("value"))).alias("q3"),
    )
    at_least = F.create_map(*[F.lit(x) for pair in slack.items() for x in pair])[F.col("rate")]
    step = spreads * F.greatest(F.col("q3") - F.col("q1"), at_least)
    wide = quartiles.select(*by, "rate", "_texts", (F.col("q1") - step).alias("lo"), (F.col("q3") + step).alias("hi"))
    return wide.groupBy(*by).agg(F.max("_texts").alias("_texts"), *[F.max(F.when(F.col("rate") == c, F.col(side))).alias(f"{side}_{c}") for c in slack for side in ("lo", "hi")])


def joined(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """rows with the columns of the one row of `table` that has the same keys, nulls being equal. count: how many rows have the keys, of `total`."""
    named = table.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in table.columns if c not in keys])
    alike = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    often = F.col(count) * 1000 > total
    hot = F.broadcast(named.where(often))  # 1000 rows at most
    gone = [f"_{k}" for k in keys]
    seldom = rows.join(F.broadcast(named.where(often).select(*gone)), alike, "left_anti")
    return rows.join(hot, alike).drop(*gone).unionByName(seldom.join(named.where(~often), alike).drop(*gone))


def judge(docs: DataFrame, lang: str = "lang", source: str = "source", least: int = LEAST, slack: dict[str, int] = SLACK, spreads: int = SPREADS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, COUNTS, base_failed, the rates and the fences they were held against, and kept."""
    by = ["_lang", "_source"]
    named = docs.select(*keep, "text", F.col(lang).alias("_lang"), F.col(source).alias("_source"))
    failed = (F.col("n_words") < WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    rows = measures(named, *keep, *by).withColumn("base_failed", failed)
    rows = cut(rows.select("*", *[F.when(~failed, rate).alias(c) for c, rate in rates().items()]))
    own = cut(sketches(rows, list(slack), by), 0)
    groups = cut(rows.groupBy(*by).agg(F.count("*").alias("_rows")), 0)
    sides = [f"{side}_{c}" for c in slack for side in ("lo", "hi")]

    def of(keys: list[str]) -> DataFrame:
        return fences(merge(own, keys), keys, slack, spreads).where(F.col("_texts") >= least) if keys else fences(merge(own, []), [], slack, spreads)

    total, langs = rows.count(), cut(groups.groupBy("_lang").agg(F.count("*").alias("_groups")), 0)
    wide = langs.join(of(["_lang"]).withColumnRenamed("_lang", "_l"), F.col("_lang").eqNullSafe(F.col("_l")), "left").drop("_l").join(F.broadcast(of([]).select(*[F.col(c).alias(f"all_{c}") for c in sides])), how="left")
    wide = wide.select("_lang", "_groups", *[F.coalesce(c, f"all_{c}").alias(f"lang_{c}") for c in sides])
    each = groups.join(of(by).withColumnsRenamed({"_lang": "_l", "_source": "_s"}), F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_l", "_s")
    each = joined(each, wide, ["_lang"], "_groups", groups.count()).select(*by, "_rows", *[F.coalesce(c, f"lang_{c}").alias(c) for c in sides])
    judged = joined(rows, cut(each, 0), by, "_rows", total)
    inside = F.lit(True)
    for c in slack:
        inside = inside & F.col(c).between(F.col(f"lo_{c}"), F.col(f"hi_{c}"))
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))).select(*keep, *COUNTS, "base_failed", *slack, *sides, "kept")


def keep_good(docs: DataFrame, **rules) -> DataFrame:
    """The rows of docs that `judge` keeps."""
    whole = docs.select(F.struct("*").alias("_row"), "text", *dict.fromkeys([rules.get("lang", "lang"), rules.get("source", "source")]))
    return judge(whole, keep=("_row",), **rules).where("kept").select("_row.*")
