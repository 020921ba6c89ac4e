"""A change feed as a streaming data source: pages of records in the order of their cursor, read by offset, gone on with after a stop.

A feed is a folder of pages, files of JSON lines that are named by the first and last cursor they hold and never change; new records
and new versions of old ones come at the end, in new pages. The offset is the last cursor that was read. A batch's
pages are read by the tasks, a page each; the driver sees names alone. `publish` writes pages from a table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: A record of the feed. body is null where the record was deleted.
RECORD = "seq long, id long, body string"


class Page(InputPartition):
    """The records of a page that come after one cursor and not after another."""

    def __init__(self, path: str, after: int, upto: int):
        self.path, self.after, self.upto = path, after, upto


def _pages(folder: str) -> list[tuple[int, int, str]]:
    """(first, last, path) of the pages of a feed, in order."""
    files, top = pafs.FileSystem.from_uri(folder)
    names = [f.base_name for f in files.get_file_info(pafs.FileSelector(top, allow_not_found=True)) if f.base_name.endswith(".jsonl") and not f.base_name.startswith(".")]
    return sorted((*map(int, n.removesuffix(".jsonl").split("-")), f"{top}/{n}") for n in names)


def _records(folder: str, page: Page) -> Iterator[tuple]:
    if not page.path:
        return
    files, _ = pafs.FileSystem.from_uri(folder)
    with files.open_input_stream(page.path) as stream:
        text = stream.read().decode()
    for line in text.split("\n"):
        if line:
            r = json.loads(line)
            if page.after < r["seq"] <= page.upto:
                yield r["seq"], r["id"], r["body"]


class FeedReader(DataSourceReader):
    """All records that are there now."""

    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Page]:
        return [Page(path, first - 1, last) for first, last, path in _pages(self.folder)] or [Page("", 0, 0)]

    def read(self, partition: Page) -> Iterator[tuple]:
        return _records(self.folder, partition)


class FeedStream(DataSourceStreamReader):
    """Records after the offset of the batch before."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"seq": -1}

    def latestOffset(self) -> dict:
        return {"seq": max((last for _, last, _ in _pages(self.folder)), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(path, start["seq"], end["seq"]) for first, last, path in _pages(self.folder) if last > start["seq"] and first <= end["seq"]]

    def read(self, partition: Page) -> Iterator[tuple]:
        return _records(self.folder, partition)


class Feed(DataSource):
    """Option: folder of the feed, in storage that driver and tasks share."""

    @classmethod
    def name(cls) -> str:
        return "recordfeed"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options["folder"])

    def streamReader(self, schema) -> FeedStream:
        return FeedStream(self.options["folder"])


def read(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(Feed)
    return spark.read.format("recordfeed").option("folder", folder).load()


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(Feed)
    return spark.readStream.format("recordfeed").option("folder", folder).load()


def publish(records: DataFrame, folder: str, page: int = 1000) -> None:
    """Adds records (seq, id, body) to a feed, in pages of `page` cursors. Cursors are unique, from 0 up, and above those of the feed."""

    def write(part: pa.Table) -> pa.Table:
        files, top = pafs.FileSystem.from_uri(folder)
        files.create_dir(top, recursive=True)
        rows = part.sort_by("seq").select(["seq", "id", "body"]).to_pylist()
        draft = f"{top}/.{uuid.uuid4().hex}"
        with files.open_output_stream(draft) as stream:
            stream.write("".join(json.dumps(r) + "\n" for r in rows).encode())
        files.move(draft, f"{top}/{rows[0]['seq']}-{rows[-1]['seq']}.jsonl")  # a task that runs again replaces its own page
        return pa.table({"n": [len(rows)]})

    rows = records.select(F.col("seq").cast("long").alias("seq"), F.col("id").cast("long").alias("id"), "body")
    rows.withColumn("_page", F.floor(F.col("seq") / page)).groupBy("_page").applyInArrow(write, "n long").agg(F.sum("n")).collect()
