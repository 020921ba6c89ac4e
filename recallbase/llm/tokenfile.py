"""Token ids in seekable binary files: independent zstandard frames, a document index, and a trailing seek table.

A file is a run of zstandard frames, each holding FRAME_IDS unsigned 32-bit little-endian ids (the last may hold
fewer); a skippable frame with a row per document (flag, doc_id, first id in the file, number of ids); and a skippable
frame in the public seekable layout, with the compressed size, plain size and low half of XXH64 of every frame. A
reader takes the seek table from the end, then only the frames that hold what it wants, and checks each of them.

Nulls and ties: a null text counts as empty; a null doc_id sorts first and comes back null; rows that repeat a doc_id
are all kept, in the order of their texts' hashes. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallbase.llm.common import cut, shared_dir, text_slices
from recallbase.llm.tokens import encoder

#: Ids in a frame: 64 KiB before compression.
FRAME_IDS = 16_384
#: Fixed values of the public zstandard formats: skippable frames and the seekable footer.
SKIPPABLE, SEEK_SKIPPABLE, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_ROW = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("start", "<u8"), ("n", "<u8")])


class Writer:
    """Writes one file to a stream, in the order in which documents are added. Holds a frame and the index."""

    def __init__(self, out, level: int = 3):
        self.out, self.tool = out, zstandard.ZstdCompressor(level=level)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((doc_id is not None, doc_id or 0, self.n_ids, len(ids)))
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= FRAME_IDS:
            joined = np.concatenate(self.held)
            whole = len(joined) // FRAME_IDS * FRAME_IDS
            for i in range(0, whole, FRAME_IDS):
                self._frame(joined[i : i + FRAME_IDS])
            self.held, self.n_held = [joined[whole:].copy()], len(joined) - whole

    def _frame(self, ids: np.ndarray) -> None:
        plain = ids.astype("<u4").tobytes()
        packed = self.tool.compress(plain)
        self.out.write(packed)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.n_held:
            self._frame(np.concatenate(self.held))
        rows = np.array(self.index, _ROW).tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE, len(rows)) + rows)
        self.frames.append((len(rows) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SEEK_SKIPPABLE, len(table)) + table)


class Reader:
    """Random access to a file by its seek table. `read` decompresses only the frames that hold the ids asked for."""

    def __init__(self, source):
        self.source = source
        end = source.seek(0, io.SEEK_END)
        source.seek(end - 9)
        n, descriptor, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC or descriptor != 0x80:
            raise ValueError("no seek table with checksums at the end")
        source.seek(end - 9 - 12 * n)
        self.table = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        source.seek(int(self.at[-2]) + 8)
        self.index = np.frombuffer(source.read(int(self.table[-1, 0]) - 8), _ROW)
        self.kept: tuple[int, bytes] = (-1, b"")
        self.opened = 0

    def frame(self, k: int) -> bytes:
        if self.kept[0] != k:
            self.source.seek(int(self.at[k]))
            plain = zstandard.ZstdDecompressor().decompress(self.source.read(int(self.table[k, 0])), max_output_size=int(self.table[k, 1]))
            if len(plain) != self.table[k, 1] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.table[k, 2]:
                raise ValueError(f"frame {k} doesn't match its checksum")
            self.kept = (k, plain)
            self.opened += 1
        return self.kept[1]

    def pieces(self, start: int, n: int) -> Iterator[bytes]:
        """The bytes of ids start .. start + n, a frame at a time."""
        while n > 0:
            k, skip = divmod(start, FRAME_IDS)
            take = min(n, FRAME_IDS - skip)
            yield self.frame(k)[4 * skip : 4 * (skip + take)]
            start, n = start + take, n - take

    def read(self, row: int) -> np.ndarray:
        return np.frombuffer(b"".join(self.pieces(int(self.index["start"][row]), int(self.index["n"][row]))), "<u4")


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Encodes and writes every document; a row (file, path, n_docs, n_ids) per file, files in doc_id order.

    Texts are sorted by range partitioning and each partition becomes a file, written beside its final name and then
    moved there, so a task that runs again replaces its own file with the same bytes.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)

    def encode(batches):
        part = TaskContext.get().partitionId()
        files, top = pafs.FileSystem.from_uri(folder)
        tool, end = encoder(tokenizer, True), np.array([end_id], np.uint32)
        name, draft = f"{top}/ids-{part:06d}.zst", f"{top}/.ids-{part:06d}-{uuid.uuid4().hex}"
        stream = writer = None
        for batch in text_slices(batches, "text"):
            if writer is None:
                files.create_dir(top, recursive=True)
                stream = files.open_output_stream(draft)
                writer = Writer(stream)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tool.encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                writer.add(doc_id, np.concatenate([ids, end]))
        if writer is not None:
            writer.close()
            stream.close()
            files.move(draft, name)
            yield pa.RecordBatch.from_pydict({"file": [part], "path": [name], "n_docs": [len(writer.index)], "n_ids": [writer.n_ids]})

    keys = (F.col("doc_id").asc_nulls_first(), F.col("_h").asc())  # texts themselves would go to the driver in the sample of keys
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("_h")).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_h")
    return cut(ordered.mapInArrow(encode, "file long, path string, n_docs long, n_ids long"))


def read(files: DataFrame, folder: str) -> DataFrame:
    """A row per document of the files written: doc_id, start (over all files), n_tokens, ids_crc32, file. Checks every frame.

    The list of files, a row each, goes through the driver for its running sum; ids do not.
    """
    rows, base, spark = [], 0, files.sparkSession
    for r in files.orderBy("file").collect():
        rows.append((r.file, r.path, base))
        base += r.n_ids
    listed = spark.createDataFrame(rows, "file long, path string, base long").repartition(max(1, min(len(rows), 10_000)))

    def decode(batches):
        files, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_input_file(row["path"]) as source:
                    reader = Reader(source)
                    index = reader.index
                    for a in range(0, len(index), 10_000):
                        part, sums = index[a : a + 10_000], []
                        for start, n in zip(part["start"].tolist(), part["n"].tolist(), strict=True):
                            crc = 0
                            for piece in reader.pieces(start, n):
                                crc = zlib.crc32(piece, crc)
                            sums.append(crc)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(part["doc_id"], mask=part["known"] == 0), pa.array(part["start"].astype(np.int64) + row["base"]), pa.array(part["n"].astype(np.int64)), pa.array(sums, pa.int64()), pa.array([row["file"]] * len(part), pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32", "file"],
                        )

    return listed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, file long")


def tokenize_to_files(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Writes the files, reads them back, and returns what they hold: doc_id, start, n_tokens, ids_crc32, file."""
    folder = folder or shared_dir(docs.sparkSession)
    return read(write(docs, tokenizer, end_id, folder), folder)
