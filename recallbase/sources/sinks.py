"""Sinks: snapshots, logs, compacted segments, vault pages, metrics text. Each is a committed Spark write; a task that runs again leaves no double rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallbase.sources.logs import apply_events, latest_records

#: The order in which an article's fields are written first.
FIELD_ORDER = ("id", "title", "text", "answer", "auto_reply", "min_score", "categories", "keywords", "source", "source_uri", "language", "communication_style")


def snapshot(state: DataFrame, folder: str, secrets: Sequence[str] = ()) -> None:
    """The whole state, without secret columns, in place of what the folder held."""
    state.drop(*secrets).write.mode("overwrite").parquet(folder)


def append_log(rows: DataFrame, folder: str, day: Column) -> None:
    """Adds rows as JSON lines, a folder a day, so that a reader of recent days opens no others."""
    rows.withColumn("day", F.to_date(day)).write.mode("append").partitionBy("day").json(folder)


def checkpoint(log: DataFrame, key: str, seq: str, upto: int, folder: str) -> DataFrame:
    """Folds the log up to `upto` into a snapshot in the folder; what comes back is the log that is still needed."""
    apply_events(log.where(F.col(seq) <= upto), key, seq).write.mode("overwrite").parquet(folder)
    return log.where(F.col(seq) > upto)


def compact(segments: DataFrame, folder: str, parts: int | None = None) -> None:
    """Rewrites segments with live records alone, sorted by id within files."""
    live = latest_records(segments).drop("deleted")
    (live.repartition("id") if parts is None else live.repartition(parts, "id")).sortWithinPartitions("id").write.mode("overwrite").parquet(folder)


def partition_vectors(rows: DataFrame, folder: str) -> None:
    """Vectors in a folder per dimension."""
    rows.where(F.size("vector") > 0).withColumn("dim", F.size("vector")).write.mode("overwrite").partitionBy("dim").parquet(folder)


def article_json(rows: DataFrame) -> Column:
    """An article as JSON with its fields in the fixed order, others by name; null fields are left out."""
    ordered = [c for c in FIELD_ORDER if c in rows.columns] + sorted(c for c in rows.columns if c not in FIELD_ORDER)
    return F.to_json(F.struct(*ordered))


def write_articles(rows: DataFrame, folder: str) -> None:
    """Articles as JSON lines in the fixed order of fields."""
    ordered = [c for c in FIELD_ORDER if c in rows.columns] + sorted(c for c in rows.columns if c not in FIELD_ORDER)
    rows.select(*ordered).write.mode("overwrite").json(folder)


def vault_pages(articles: DataFrame, edges: DataFrame) -> DataFrame:
    """path and content of a linked Markdown page per article (id, title, text, source) and per linked item (edges from, to, title) that is no article."""
    links = edges.groupBy(F.col("from").alias("id")).agg(F.array_sort(F.collect_set(F.struct("to", "title"))).alias("links"))
    listed = F.array_join(F.transform(F.coalesce("links", F.array().cast("array<struct<to:string,title:string>>")), lambda x: F.concat(F.lit("- [["), x["to"], F.lit("|"), F.coalesce(x["title"], x["to"]), F.lit("]]"))), "\n")
    page = F.concat(F.lit("---\nid: "), F.col("id"), F.lit("\nsource: "), F.coalesce("source", F.lit("")), F.lit("\n---\n\n# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n\n"), listed, F.lit("\n"))
    own = articles.join(links, "id", "left").select(F.concat(F.lit("articles/"), "id", F.lit(".md")).alias("path"), page.alias("content"))
    stubs = edges.select(F.col("to").alias("id"), "title").join(articles.select("id"), "id", "left_anti").groupBy("id").agg(F.min("title").alias("title"))
    stub = stubs.select(F.concat(F.lit("linked/"), "id", F.lit(".md")).alias("path"), F.concat(F.lit("# "), F.coalesce("title", "id"), F.lit("\n")).alias("content"))
    return own.unionByName(stub)


def write_vault(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the pages, packed as rows of path and content, and a manifest (path, bytes, sha256), which comes back."""
    pages.write.mode("overwrite").parquet(f"{folder}/pages")
    written = pages.sparkSession.read.parquet(f"{folder}/pages")
    manifest = written.select("path", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return written.sparkSession.read.parquet(f"{folder}/manifest")


def exposition(samples: DataFrame) -> Column:
    """A metrics line of a sample (metric, labels as a map, value): labels by name, values escaped."""
    escaped = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), escaped(e["value"]), F.lit('"')))
    shown = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    return F.concat(F.col("metric"), shown, F.lit(" "), F.col("value").cast("string"))


def write_exposition(samples: DataFrame, folder: str) -> None:
    samples.select(exposition(samples).alias("value")).write.mode("overwrite").text(folder)


def read_text(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.text(folder)
