"""Drafts and prompts: strict JSON, lengths, context lines, batches for an embedder, provenance of candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallbase.functions import text as T

_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def strict_object(raw: Column, fields: Sequence[str]) -> Column:
    """struct(value, error) of text that must be one JSON object with no other than these fields (in any case): error is null, `invalid`, `not_an_object`, `multiple_values` or `unknown_field`.

    The text is read inside another object with a field after it: whatever follows the first value shows up there.
    """
    known = F.array(*[F.lit(f.lower()) for f in fields]).cast("array<string>")
    blank = F.trim(F.coalesce(raw, F.lit(""))) == ""
    first = F.from_json(raw, "map<string,string>", _STRICT)
    around = F.from_json(F.concat(F.lit('{"value":'), raw, F.lit(',"end":1}')), "map<string,string>", _STRICT)

    def judged(x: Column) -> Column:
        names = F.array_sort(F.map_keys(x["around"]))
        whole = F.coalesce(names == F.array(F.lit("end"), F.lit("value")), F.lit(False))
        error = (
            F.when(x["blank"] | (x["first"].isNull() & x["around"].isNull()), "invalid").when(~whole, "multiple_values").when(x["first"].isNull(), "not_an_object")
            .when(F.exists(F.map_keys(x["first"]), lambda k: ~F.array_contains(known, F.lower(k))), "unknown_field")
        )
        return F.struct(F.when(error.isNull(), x["first"]).alias("value"), error.alias("error"))

    return T.once(F.struct(blank.alias("blank"), first.alias("first"), around.alias("around")), judged)


def quality(text: Column, answer: Column, pack: Column, evidence: Column, expanded: Column, tokens: Column, bounds: tuple[int, int, int]) -> Column:
    """struct of an article's measures: characters of text, answer and evidence, the bounds it was written for (least, wanted, most), pieces of evidence, whether it was expanded, tokens spent."""
    n = lambda c: F.length(F.trim(F.coalesce(c, F.lit(""))))
    return F.struct(
        n(text).alias("text_chars"), n(answer).alias("answer_chars"), F.lit(bounds[0]).alias("min_text_chars"), F.lit(bounds[1]).alias("target_text_chars"), F.lit(bounds[2]).alias("max_text_chars"),
        evidence.alias("evidence_items"), n(pack).alias("evidence_prompt_chars"), expanded.alias("expansion_applied"), tokens.alias("synthesis_tokens"),
    )


def prompt_context(hits: DataFrame, most: int = 0) -> DataFrame:
    """query_id and context: a numbered line per hit (query_id, rank, id, memory_type, status, shard, similarity, text), the first `most` of each query, all if 0."""
    rows = hits.where(F.col("rank") <= most) if most > 0 else hits
    line = F.format_string("[%d | type=%s | status=%s | shard=%s | sim=%.3f | id=%s] %s", "rank", "memory_type", "status", "shard", "similarity", F.col("id").cast("string"), "text")
    g = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return g.select("query_id", F.regexp_replace(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), r"^\s+|\s+$", "").alias("context"))


def any_relevant(results: DataFrame, anchors: Column, *texts: str) -> DataFrame:
    """goal_id, relevant: does any result of a goal treat it? The texts of a result are read as one."""
    fits = T.material_relevant(anchors, F.concat_ws(" ", *texts))
    return results.groupBy("goal_id").agg(F.bool_or(fits).alias("relevant"))


def embedded(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """id and vector of rows (id, text): `embed` gets at most `batch` texts at a time, in the order in which a task meets them; null texts are empty ones. An answer of another length is an error."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for a in range(0, part.num_rows, batch):
                some = part.slice(a, batch)
                vectors = embed([t or "" for t in some.column("text").to_pylist()])
                if len(vectors) != some.num_rows:
                    raise ValueError(f"{some.num_rows} texts gave {len(vectors)} vectors")
                yield pa.RecordBatch.from_arrays([some.column("id").cast(pa.int64()), pa.array(vectors, pa.list_(pa.float64()))], names=["id", "vector"])

    return rows.select("id", "text").mapInArrow(work, "id long, vector array<double>")


def merged_candidates(parts: Sequence[tuple[str, DataFrame]], k: int) -> DataFrame:
    """query_id, id, similarity, candidate_source, rank of the k best candidates (query_id, id, similarity) of several generators: each once, with its best similarity and all generators that named it, in their order."""
    rows = reduce(DataFrame.unionByName, [hits.select("query_id", "id", "similarity", F.lit(i).alias("n")) for i, (_, hits) in enumerate(parts)])
    names = F.array(*[F.lit(name) for name, _ in parts])
    g = rows.groupBy("query_id", "id").agg(F.max("similarity").alias("similarity"), F.array_sort(F.collect_set("n")).alias("n"))
    best = Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), "id")
    return g.select("query_id", "id", "similarity", F.array_join(F.transform("n", lambda i: F.get(names, i)), "+").alias("candidate_source")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def synthetic_vectors(spark: SparkSession, n: int, dim: int) -> DataFrame:
    """id, vector: n reproducible unit vectors, from a shift register and a multiplication per component, seeded by the id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            ids = part.column("id").to_numpy()
            with np.errstate(over="ignore"):
                x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
                out = np.zeros((len(ids), dim), np.float32)
                for j in range(dim):
                    x ^= x >> np.uint64(12)
                    x ^= x << np.uint64(25)
                    x ^= x >> np.uint64(27)
                    out[:, j] = ((x * np.uint64(2685821657736338717)) >> np.uint64(32)).astype(np.uint32).view(np.int32).astype(np.float32) / np.float32(2**31 - 1)
            norm = np.sqrt((out * out).astype(np.float64).sum(1, keepdims=True))
            out *= np.divide(1, norm, out=np.zeros_like(norm), where=norm > 0).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(out), pa.list_(pa.float32()))], names=["id", "vector"])

    return spark.range(n).mapInArrow(work, "id long, vector array<float>")
