"""Append-only logs: JSON lines with damaged ones, event folds, segments, vector tables by dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of JSON lines, with _corrupt holding the text of a line that can't be read (its other columns are null). Lines may be of any length."""
    full = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return spark.read.text(folder).select(F.from_json("value", full, options).alias("r")).select("r.*")


def sound(rows: DataFrame) -> DataFrame:
    return rows.where("_corrupt is null").drop("_corrupt")


def apply_events(log: DataFrame, key: str, seq: str, after: Column | None = None) -> DataFrame:
    """State after a log of events (key, seq, op, delta, payload) of the kinds `upsert`, `delete`, `replace` and `add`.

    Per key the last event that sets or deletes it decides; amounts added after that one are summed. So an event log of any
    order and partitioning folds with two aggregations, combined before their shuffle. Keys deleted last are absent.
    """
    rows = log if after is None else log.where(F.col(seq) > after)
    sets = F.col("op").isin("upsert", "replace", "delete")
    last = rows.where(sets).groupBy(key).agg(F.max_by(F.struct("op", "payload", "delta"), F.col(seq)).alias("s"), F.max(seq).alias("_at"))
    adds = rows.where("op = 'add'").join(last.select(key, "_at"), key, "left").where(F.col("_at").isNull() | (F.col(seq) > F.col("_at"))).groupBy(key).agg(F.sum("delta").alias("_added"))
    both = last.where("s.op <> 'delete'").join(adds, key, "left")
    return both.select(key, F.col("s.payload").alias("payload"), (F.coalesce("s.delta", F.lit(0)) + F.coalesce("_added", F.lit(0))).alias("amount"), F.col("_at").alias("revision"))


def latest_records(segments: DataFrame, key: str = "id", revision: str = "revision", place: str = "place", deleted: str = "deleted") -> DataFrame:
    """Live records of append-only segments: the highest revision of each key, the later place among equals, unless it is a tombstone."""
    newest = segments.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*segments.columns), F.struct(revision, place)).alias("r")).select("r.*")
    return newest.where(~F.col(deleted))


def segment_statistics(segments: DataFrame, key: str = "id", revision: str = "revision", place: str = "place", deleted: str = "deleted") -> DataFrame:
    """records, live, tombstones (latest records that are deletions) and superseded (all others)."""
    newest = segments.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.col(deleted), F.struct(revision, place)).alias("dead"), F.count("*").alias("n"))
    return newest.agg(F.sum("n").alias("records"), F.count_if(~F.col("dead")).alias("live"), F.count_if(F.col("dead")).alias("tombstones"), (F.sum("n") - F.count("*")).alias("superseded"))


def vectors_of(spark: SparkSession, folder: str, dim: int) -> DataFrame:
    """id and vector of one dimension from a table partitioned by it: other dimensions' files aren't opened, other columns aren't read."""
    return spark.read.parquet(folder).where(F.col("dim") == dim).select("id", "vector")
