"""A meta-search service as a data source: a partition per query, results as rows."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RESULT = "query string, place int, title string, url string, content string, engine string, score double"


def answer_name(query: str) -> str:
    """The file of a recorded answer."""
    return f"{urllib.parse.quote(query, safe='')}.json"


class MetaSearchReader(DataSourceReader):
    def __init__(self, options):
        self.base, self.queries = options["url"].rstrip("/"), json.loads(options["queries"])
        self.most, self.timeout, self.language = int(options.get("most", 10)), float(options.get("timeout", 10)), options.get("language", "")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(q) for q in self.queries]

    def _answer(self, query: str) -> bytes:
        if not self.base.startswith(("http://", "https://")):
            files, top = pafs.FileSystem.from_uri(self.base)
            path = f"{top}/{answer_name(query)}"
            if files.get_file_info(path).type == pafs.FileType.NotFound:
                return b"{}"
            with files.open_input_stream(path) as stream:
                return stream.read()
        asked = {"q": query, "format": "json"} | ({"language": self.language} if self.language else {})
        with urllib.request.urlopen(f"{self.base}/search?{urllib.parse.urlencode(asked)}", timeout=self.timeout) as answer:
            return answer.read()

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        found = json.loads(self._answer(partition.value)).get("results") or []
        for place, r in enumerate([r for r in found if str(r.get("url") or "").startswith(("http://", "https://"))][: self.most], 1):
            yield partition.value, place, str(r.get("title") or ""), r["url"], str(r.get("content") or ""), str(r.get("engine") or ""), float(r.get("score") or 0.0)


class MetaSearch(DataSource):
    """Options: url of the service, or of a folder of recorded answers, queries as a JSON array, most results a query, timeout in seconds, language. Results that aren't web addresses are passed over; a service that fails fails its task."""

    @classmethod
    def name(cls) -> str:
        return "metasearch"

    def schema(self) -> str:
        return RESULT

    def reader(self, schema) -> MetaSearchReader:
        return MetaSearchReader(self.options)


def record(results: DataFrame, folder: str) -> None:
    """Writes results (query, place, title, url, score), a bounded list for each query, as answers that `search` reads in place of a service."""

    def write(part: pa.Table) -> pa.Table:
        files, top = pafs.FileSystem.from_uri(folder)
        files.create_dir(top, recursive=True)
        rows = part.sort_by("place").to_pylist()
        draft = f"{top}/.{uuid.uuid4().hex}"
        with files.open_output_stream(draft) as stream:
            stream.write(json.dumps({"results": [{k: r[k] for k in ("title", "url", "score")} for r in rows]}).encode())
        files.move(draft, f"{top}/{answer_name(rows[0]['query'])}")
        return pa.table({"n": [len(rows)]})

    results.groupBy("query").applyInArrow(write, "n long").agg({"n": "sum"}).collect()


def search(spark: SparkSession, url: str, queries: list[str], most: int = 10) -> DataFrame:
    spark.dataSource.register(MetaSearch)
    return spark.read.format("metasearch").option("url", url).option("queries", json.dumps(queries)).option("most", most).load()
