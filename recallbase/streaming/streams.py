"""Streams over the fact tables: tumbling costs, run traces, deduplication by version and key, sessions, idempotent sinks.

Every stream has a watermark, so its state is bounded by the event time it spans and not by the length of the stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallbase.operators.shared import new_folder


def table_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table, a file or a folder of files, as a stream of its files; the schema is that of the files."""
    glob = f"{path[:-1]}[{path[-1]}]"  # a path that is no glob would have to be a folder
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(glob)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now into a table in the shared folder, exactly once, and reads that table."""
    spark = stream.sparkSession
    folder = new_folder(spark, name)
    stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB, as timers and maps of state need it."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def event_time(rows: DataFrame, column: str, late: str) -> DataFrame:
    """rows with `at` as a timestamp and a watermark on it. Rows without a time are left out, as no window can hold them."""
    return rows.withColumn("at", F.col(column).cast("timestamp")).where("at is not null").withWatermark("at", late)


def tumbling(rows: DataFrame, width: str, keys: Sequence[str], *measures) -> DataFrame:
    """Measures per window and keys, once the watermark has passed the window."""
    g = rows.groupBy(F.window("at", width), *keys).agg(*measures)
    return g.select(F.col("window.start").alias("start"), *[c for c in g.columns if c != "window"])


def sliding(rows: DataFrame, width: str, slide: str, keys: Sequence[str], *measures) -> DataFrame:
    g = rows.groupBy(F.window("at", width, slide), *keys).agg(*measures)
    return g.select(F.col("window.start").alias("start"), *[c for c in g.columns if c != "window"])


def sessions(rows: DataFrame, gap: str, keys: Sequence[str], *measures) -> DataFrame:
    """Measures per session of a key: rows not further apart than `gap`."""
    g = rows.groupBy(F.session_window("at", gap), *keys).agg(*measures)
    return g.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *[c for c in g.columns if c != "session_window"])


def first_of(rows: DataFrame, *keys: str) -> DataFrame:
    """The first row seen of each key within the watermark: idempotency keys, versions of a ticket that were seen, work that is queued already."""
    return rows.dropDuplicatesWithinWatermark(list(keys))


def each_batch(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None]) -> None:
    """Hands every micro-batch that is there now to `work`, with its number; `work` must be idempotent by that number."""
    stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_batches(stream: DataFrame, folder: str) -> None:
    """A log that holds each batch once: a batch that runs again replaces its own folder."""

    def work(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    each_batch(stream, f"{folder}/offsets", work)


def last_version(spark: SparkSession, folder: str) -> int | None:
    """The number of the last version of a state that was written whole, None if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/state-*/_SUCCESS")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return max((int(f.getPath().getParent().getName().removeprefix("state-")) for f in there), default=None)


def merge_latest(stream: DataFrame, folder: str, key: str, order: str) -> DataFrame:
    """State of the latest row per key over all batches: a version of the state per batch, read from the one before and written beside it."""
    spark, schema = stream.sparkSession, stream.schema

    def work(batch: DataFrame, number: int) -> None:
        rows = batch
        if number > 0:
            rows = spark.read.schema(schema).parquet(f"{folder}/state-{number - 1}").unionByName(batch)
        newest = rows.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*schema.names), F.col(order)).alias("r")).select("r.*")
        newest.write.mode("overwrite").parquet(f"{folder}/state-{number}")

    each_batch(stream, f"{folder}/offsets", work)
    last = last_version(spark, folder)
    return spark.createDataFrame([], schema) if last is None else spark.read.schema(schema).parquet(f"{folder}/state-{last}")
