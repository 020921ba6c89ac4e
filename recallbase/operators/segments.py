"""A stored vector index that changes: a base, versioned delta segments with tombstones over it, search over all, compaction.

A segment is a folder that is written once: the rows that one batch of changes put in, encoded with the index's codebooks, and a
tombstone for each id that it deleted. A later segment overrides an earlier one by id. Only ids of deltas are compared; rows of the
base that no delta touches are never rewritten. A batch has a name and is applied once, so one that runs again
changes nothing. Compaction folds all segments into a new base beside the old one and moves the manifest on, so readers see either.

The index holds vectors for exact scores of the candidates, their dimension for the consistency check, and codes for the search.
Null vectors in a batch are deletions, repeated ids within a batch count once, the row of the largest `seq`, then the largest vector.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallbase.operators import quantized
from recallbase.operators.quantized import Codebooks
from recallbase.operators.shared import cut, small

_ROW = "id long, deleted boolean, dim int, vector array<double>, codes binary, cell int"


@dataclass(frozen=True)
class Index:
    """A manifest: where segments lie, oldest first, with the batches they came of."""

    folder: str
    segments: tuple[tuple[str, str], ...]  # (folder, batch)


def _encoded(rows: DataFrame, model: Codebooks) -> DataFrame:
    """rows (id, vector) as those of a segment; vectors of another dimension than the model's are kept in cell -1 for exact scores."""
    codes = quantized.encode(rows, model)
    joined = rows.join(codes, "id", "left")
    return joined.select("id", F.col("vector").isNull().alias("deleted"), F.size("vector").alias("dim"), "vector", "codes", F.coalesce("cell", F.lit(-1)).alias("cell"))


def _write(index: Index, rows: DataFrame, batch: str) -> Index:
    name = f"{index.folder}/segment-{len(index.segments)}"
    rows.write.mode("overwrite").partitionBy("cell").parquet(name)
    return Index(index.folder, (*index.segments, (name, batch)))


def create(vectors: DataFrame, model: Codebooks, folder: str) -> Index:
    """An index whose base are vectors (id, vector); null vectors and ids are left out."""
    rows = cut(vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).dropna().groupBy("id").agg(F.max("vector").alias("vector")))
    return _write(Index(folder, ()), _encoded(rows, model), "base")


def apply(index: Index, changes: DataFrame, model: Codebooks, batch: str) -> Index:
    """The index after a batch of changes (seq, id, vector): rows put in or replaced, or deleted where the vector is null."""
    if any(b == batch for _, b in index.segments):
        return index
    last = F.max_by(F.struct("vector"), F.struct("seq", "vector"))
    rows = cut(changes.where("id is not null").select("seq", F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).groupBy("id").agg(last.alias("r")).select("id", "r.vector"))
    return _write(index, _encoded(rows, model), batch)


def live(spark: SparkSession, index: Index) -> DataFrame:
    """id, segment, dim, vector, codes, cell of the rows that count: of each id its latest, unless that is a tombstone."""
    parts = [spark.read.schema(_ROW).parquet(name).withColumn("segment", F.lit(n)) for n, (name, _) in enumerate(index.segments)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    if len(parts) > 1:
        touched = parts[1].select("id", "segment")
        for p in parts[2:]:
            touched = touched.unionByName(p.select("id", "segment"))
        latest = cut(touched.groupBy("id").agg(F.max("segment").alias("_latest")))  # ids of deltas alone
        rows = rows.join(small(latest), "id", "left").where(F.col("_latest").isNull() | (F.col("segment") == F.col("_latest"))).drop("_latest")
    return rows.where(~F.col("deleted")).select("id", "segment", "dim", "vector", "codes", "cell")


def compact(spark: SparkSession, index: Index, folder: str) -> Index:
    """The same index as one base in a new folder. Codes are carried over, nothing is encoded again."""
    rows = live(spark, index).select("id", F.lit(False).alias("deleted"), "dim", "vector", "codes", "cell")
    return _write(Index(folder, ()), rows, json.dumps([b for _, b in index.segments]))


def needs_compaction(spark: SparkSession, index: Index, share: float = 0.25) -> bool:
    """Whether rows that don't count make up more than `share` of all that are stored."""
    stored = sum(spark.read.schema(_ROW).parquet(name).count() for name, _ in index.segments)
    return stored > 0 and stored - live(spark, index).count() > share * stored


def consistency(spark: SparkSession, index: Index, vectors: DataFrame) -> DataFrame:
    """dim, indexed, expected, consistent: rows that count in the index against the vectors (id, vector) that should be in it, for each dimension."""
    there = live(spark, index).groupBy("dim").agg(F.count("*").alias("indexed"))
    wanted = vectors.where("id is not null and vector is not null").groupBy(F.size("vector").alias("dim")).agg(F.count_distinct("id").alias("expected"))
    both = there.join(wanted, "dim", "full_outer").select("dim", F.coalesce("indexed", F.lit(0)).alias("indexed"), F.coalesce("expected", F.lit(0)).alias("expected"))
    return both.withColumn("consistent", F.col("indexed") == F.col("expected"))


def search(spark: SparkSession, index: Index, model: Codebooks, queries: DataFrame, k: int, probes: int, candidates: int = 320) -> DataFrame:
    """query_id, id, similarity, rank: the k best rows that count by cosine, of the `candidates` best by their codes in the cells nearest to each query."""
    rows = cut(live(spark, index))
    found = quantized.search_rows(rows.where("cell >= 0").select("id", "cell", "codes"), model, queries, candidates, probes)
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("_q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    exact = found.select("query_id", "id").join(rows.select("id", "vector"), "id").join(asked, "query_id").withColumn("similarity", dot("vector", "_q") / F.sqrt(dot("vector", "vector") * dot("_q", "_q")))
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "id")
    return exact.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "id", "similarity", "rank")
