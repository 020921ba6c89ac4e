"""Lineage cuts and new folders in the storage that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Ranges that a round of first_rows counts; rows that are sorted in the end.
BUCKETS, SORTED = 1024, 100_000


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where the setting is absent, a folder is made for the session, but only when all run on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='recallbase-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df to be sent to all tasks if it has at most `most` rows, else as it is, for a join by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def in_blocks(queries: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], size: int = 4096) -> DataFrame:
    """The union of work(block) over a stated set of queries, in blocks of about `size` rows at most, each to be sent to all tasks."""
    n = queries.count()
    blocks = 1 if n <= size else -(-2 * n // size)
    if blocks == 1:
        return work(F.broadcast(queries))
    place = F.pmod(F.xxhash64(key), F.lit(blocks))
    return reduce(DataFrame.union, [work(F.broadcast(queries.where(place == b))) for b in range(blocks)])


#: Rows of numbers in a file of a checkpoint, at least, where their count is known.
FILE_ROWS = 100_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder, so that a lost executor costs a read and nothing is computed twice.

    rows: about how many there are, where known; then small tables aren't spread over a file per shuffle partition.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_root(df.sparkSession))
    return (df if rows is None else in_files(df, rows)).checkpoint(eager=True)


def in_files(df: DataFrame, rows: int) -> DataFrame:
    """df of about `rows` light rows in no more partitions than hold FILE_ROWS each, or than there are cores."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, rows // FILE_ROWS))


def first_rows(rows: DataFrame, most: float, order: str, tie: str, weight: str | None = None, by_tie: bool = False) -> DataFrame:
    """The first rows by (order, tie) whose number, or sum of a weight that isn't negative, stays within `most`, however many they are: no task gets all rows. `order` must be numbers without nulls.

    Each round adds up the rows between two bounds in BUCKETS ranges and goes on in the one where the limit lies, until
    that range holds SORTED rows or a single value; only these are ranked, by tie, of which the same holds. Rows that share
    both can't be told apart, any of them will do. by_tie: order and tie have changed their places already.
    """
    w = F.lit(1) if weight is None else F.col(weight)
    held = rows.withColumn("_v", F.col(order).cast("double")).withColumn("_w", w)
    bounds = held.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count("*").alias("n"), F.sum("_w").alias("w")).first()
    if not bounds.n or bounds.w <= most:
        return rows
    lo, hi, before, inside = bounds.lo, bounds.hi, 0, bounds.n
    while inside > SORTED and hi > lo:
        bucket = F.least(F.floor((F.col("_v") - lo) / ((hi - lo) / BUCKETS)), F.lit(BUCKETS - 1))
        sums = held.where((F.col("_v") >= lo) & (F.col("_v") <= hi)).groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.sum("_w").alias("w"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        for r in sorted(sums.collect(), key=lambda r: r.b):  # BUCKETS rows at most
            if before + r.w > most:
                break
            before += r.w
        if (r.lo, r.hi) == (lo, hi):
            break
        lo, hi, inside = r.lo, r.hi, r.n
    edge = held.where((F.col("_v") >= lo) & (F.col("_v") <= hi))
    if hi > lo or inside <= SORTED:
        spent = F.sum("_w").over(Window.orderBy(order, tie).rowsBetween(Window.unboundedPreceding, 0))  # SORTED rows
        last = edge.withColumn("_s", spent).where(F.col("_s") <= most - before).drop("_s")
    elif by_tie:
        last = edge.limit(int(most - before)) if weight is None else edge.limit(int((most - before) // max(edge.agg(F.max("_w")).first()[0], 1e-9)))
    else:  # one value that very many rows share: on by the tie
        last = first_rows(edge.drop("_v", "_w"), most - before, tie, order, weight, by_tie=True)
    return held.where(F.col("_v") < lo).drop("_v", "_w").unionByName(last.drop("_v", "_w"))
