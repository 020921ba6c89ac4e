"""Text of document files: HTML, JSON, plain text and word-processor archives. Files are read as rows of bytes; each is worked on alone."""

from __future__ import annotations

import html
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallbase.functions.text import SEPARATORS

#: Extensions of plain text, and what ends of HTML blocks become.
TEXT_SUFFIXES = (".txt", ".md", ".markdown", ".csv", ".tsv", ".log")
BLOCK_ENDS = {"</p>": "\n\n", "</h1>": "\n\n", "</h2>": "\n\n", "</h3>": "\n\n", "</div>": "\n", "</li>": "\n", "<br>": "\n", "<br/>": "\n", "<br />": "\n"}
_BLOCK = re.compile("|".join(map(re.escape, BLOCK_ENDS)))
_PART = re.compile(r"<w:t(?:\s[^>]*)?>(.*?)</w:t>|(</w:p>)|(<w:tab\s*/>)", re.S)
#: White space by Unicode, which is taken off the ends of a line.
_SPACE = "\t\n\v\f\r \x85\u2028\u2029" + SEPARATORS


def tidy(text: str) -> str:
    """Blanks of ASCII collapsed per line, white space trimmed, at most one empty line in a row. A no-break space within a line stays."""
    lines = [re.sub(r"[ \t\v\f\r]+", " ", x).strip(_SPACE) for x in text.replace("\0", "").split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip(_SPACE)


def html_text(page: str) -> str:
    out = re.sub(r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ", page)
    out = re.sub(r"(?s)<!--.*?-->", " ", out)
    out = _BLOCK.sub(lambda m: BLOCK_ENDS[m[0]], out)
    return tidy(html.unescape(re.sub(r"<[^>]*>", " ", out)))


def docx_paragraphs(data: bytes) -> list[str]:
    """The paragraphs of word/document.xml, empty ones too: their text runs as they stand there, and tabs."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = z.read("word/document.xml").decode("utf-8", "replace")
    out, runs = [], []
    for m in _PART.finditer(body):
        if m[2]:
            out.append("".join(runs))
            runs = []
        else:
            runs.append("\t" if m[3] else html.unescape(m[1]))
    return [*out, "".join(runs)] if runs else out


def docx_text(data: bytes) -> str:
    """Text runs of word/document.xml; a paragraph ends in an empty line."""
    return tidy("\n\n".join(docx_paragraphs(data)))


def extract(name: str, data: bytes | None) -> tuple[str | None, str | None]:
    """(text, error) of a file by its name. PDFs need a program of their own and are an error here, as is what can't be read."""
    low = (name or "").lower()
    try:
        if data is None:
            return None, "no content"
        if low.endswith((".html", ".htm")):
            return html_text(data.decode("utf-8", "replace")), None
        if low.endswith(".docx"):
            return docx_text(data), None
        if low.endswith(".json"):
            return json.dumps(json.loads(data), ensure_ascii=False, indent=2), None
        if low.endswith(TEXT_SUFFIXES):
            return tidy(data.decode("utf-8", "replace")), None
        return None, f"unsupported: {low.rpartition('.')[2]}"
    except (ValueError, KeyError, zipfile.BadZipFile) as e:
        return None, f"{type(e).__name__}: {e}"


#: Files that a task takes apart at once.
FILES = 64


def by_slices(rows: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """work over FILES rows at a time, so that no more of them than that are Python objects at once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FILES):
                yield work(batch.slice(at, FILES))

    return rows.mapInArrow(each, schema)


def texts(files: DataFrame) -> DataFrame:
    """name, text and error of files (name, content)."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        made = [extract(n.as_py(), c.as_py()) for n, c in zip(part.column("name"), part.column("content"), strict=True)]
        return pa.RecordBatch.from_arrays([part.column("name").cast(pa.string()), pa.array([t for t, _ in made], pa.string()), pa.array([e for _, e in made], pa.string())], names=["name", "text", "error"])

    return by_slices(files.select("name", F.col("content").cast("binary").alias("content")), work, "name string, text string, error string")


def paragraphs(files: DataFrame) -> DataFrame:
    """name, paragraphs and error of word-processor archives (name, content). Blanks are left as they are, for those who need a text to the character."""

    def held(data: bytes | None) -> tuple[list[str] | None, str | None]:
        try:
            return (None, "no content") if data is None else (docx_paragraphs(data), None)
        except (ValueError, KeyError, zipfile.BadZipFile) as e:
            return None, f"{type(e).__name__}: {e}"

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        made = [held(c.as_py()) for c in part.column("content")]
        return pa.RecordBatch.from_arrays([part.column("name").cast(pa.string()), pa.array([p for p, _ in made], pa.list_(pa.string())), pa.array([e for _, e in made], pa.string())], names=["name", "paragraphs", "error"])

    return by_slices(files.select("name", F.col("content").cast("binary").alias("content")), work, "name string, paragraphs array<string>, error string")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """name and content of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")


def char_chunks(text: str | None, size: int = 2400, over: int = 280, most: int | None = None) -> list[str]:
    """Pieces of at most `size` characters, each `over` characters into the one before; a piece ends at the last sentence mark or white space of its last quarter, if there is one. With `most`, no more than the first so many."""
    text, out, at = tidy(text or ""), [], 0
    over = over if 0 <= over < size else size // 8 if over > 0 else 0
    while at < len(text) and (most is None or len(out) < most):
        end = min(len(text), at + size)
        if end < len(text):
            end = next((i for i in range(end, at + size * 3 // 4, -1) if text[i - 1] in ".!?" or text[i - 1].isspace()), end)
        piece = text[at:end].strip()
        if piece:
            out.append(piece)
        if end >= len(text):
            break
        at = end - over if end - over > at else end
    return out


def chunked(rows: DataFrame, key: str, size: int = 2400, over: int = 280, most: int | None = None) -> DataFrame:
    """key, chunk (from 0) and text of each row's pieces."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(k, i, piece) for k, t in zip(batch[key], batch["text"], strict=True) for i, piece in enumerate(char_chunks(t, size, over, most))]
            yield pd.DataFrame(made, columns=[key, "chunk", "text"])

    return rows.select(key, "text").mapInPandas(work, f"{key} {dict(rows.dtypes)[key]}, chunk int, text string")
