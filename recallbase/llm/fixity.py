"""Merkle fixity audit of WARC records.

Records are grouped into files and ordered within them; each has an offset, a length and the SHA-256 of its bytes. Over
a file's records stands a tree: a node is an ordered range of FAN children, and its hash covers their hashes and their
offset range. Over the files' roots stands another tree of the same kind, up to one root. Two replicas are compared from
that root: at each level only children of nodes that differ are read, so the cost follows the damage. What differs among
the records is located by file, offset and record.

Levels are rows of one table (level, node, hash), so each step is a join of one level with the few nodes that differ.
A node gathers FAN children at most. Files are ranges of PER_FILE page_ids.

Nulls and ties: a null url or html counts as empty; null page_ids form NO_ID_FILES files of their own, dealt by digest, beyond those
of all ids; rows that repeat a page_id are separate records, ordered by digest. Extra columns are ignored. An empty replica has no root; against it every record
of the other is missing. Two empty replicas give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallbase.llm.common import cut

#: Children of a node; page_ids of a file; files of records without an id, and the first of them, beyond the file of any long.
FAN, PER_FILE, NO_ID_FILES, NO_ID = 16, 1024, 256, 1 << 53


def record_bytes(url: Column, payload: Column, date: str = "1970-01-01T00:00:00Z") -> Column:
    """A WARC/1.1 resource record with the payload as its block. Its id is a UUID by the MD5 of url and payload; date: when the pages were taken."""
    url, payload = F.coalesce(url, F.lit("")), F.coalesce(payload, F.lit(""))
    name = F.regexp_replace(F.md5(F.concat(url, F.lit("\n"), payload).cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), name, F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, payload, F.lit("\r\n\r\n"))


def records(pages: DataFrame) -> DataFrame:
    """file, page_id, record, start, length, digest of every page. Only sizes and digests are shuffled."""
    raw = record_bytes(F.col("url"), F.col("html"))
    rows = pages.select("page_id", F.octet_length(raw).cast("long").alias("length"), F.sha2(raw, 256).alias("digest"))
    file = F.when(F.col("page_id").isNull(), F.lit(NO_ID) + F.pmod(F.xxhash64("digest"), F.lit(NO_ID_FILES))).otherwise(F.floor(F.col("page_id") / F.lit(PER_FILE)).cast("long"))
    rows = rows.withColumn("file", file)
    order = Window.partitionBy("file").orderBy("page_id", "digest")
    return rows.withColumn("record", F.row_number().over(order).cast("long") - 1).withColumn("start", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))


def _above(level: DataFrame, *keys: str) -> DataFrame:
    """Nodes one level up: FAN neighbouring children each, with their hashes and range of offsets."""
    children = F.array_sort(F.collect_list(F.struct("node", "hash", "start", "end")))
    grouped = level.groupBy(*keys, F.floor(F.col("node") / F.lit(FAN)).cast("long").alias("_up")).agg(children.alias("c"))
    told = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["hash"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return grouped.select(*keys, F.col("_up").alias("node"), F.sha2(told, 256).alias("hash"), F.array_min(F.transform("c", lambda x: x["start"])).alias("start"), F.array_max(F.transform("c", lambda x: x["end"])).alias("end"))


def _depth(nodes: int) -> int:
    """Levels above the leaves until one node is left."""
    depth = 0
    while nodes > 1:
        nodes, depth = -(-nodes // FAN), depth + 1
    return depth


class Tree:
    """levels[0] are a replica's records and the last level its root: DataFrames of tree, node, hash, start, end. Both replicas of an audit have the same depths."""

    def __init__(self, rows: DataFrame, record_depth: int, file_depth: int):
        level = rows.select(F.col("file").alias("tree"), F.col("record").alias("node"), F.col("digest").alias("hash"), "start", (F.col("start") + F.col("length")).alias("end"))
        self.records = [level]
        for _ in range(record_depth):
            level = cut(_above(level, "tree"))
            self.records.append(level)
        files = level.select((F.col("tree") + 1).alias("node"), "hash", F.col("tree").alias("start"), F.col("tree").alias("end"))
        self.files = [files]
        for _ in range(file_depth):
            files = cut(_above(files))
            self.files.append(files)


def _differing(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    left, right = a.select(*keys, F.col("hash").alias("hash_a")), b.select(*keys, F.col("hash").alias("hash_b"))
    return left.join(right, list(keys), "full").where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))


def _children(level: DataFrame, parents: DataFrame, *keys: str) -> DataFrame:
    named = parents.select(*keys, F.col("node").alias("_up"))
    return level.withColumn("_up", F.floor(F.col("node") / F.lit(FAN)).cast("long")).join(named, [*keys, "_up"], "left_semi").drop("_up")


def audit(one: DataFrame, two: DataFrame) -> DataFrame:
    """file, page_id, record, start, length, digest, other_digest, status of every record at which two replicas (rows of `records`) differ.

    status: `changed`, `missing` (in the second) or `extra` (only there); page_id, start and length are the first's where it has the record.
    """
    return _audit(cut(one), cut(two))


def _audit(one: DataFrame, two: DataFrame) -> DataFrame:
    size = one.select("file", "record").union(two.select("file", "record")).agg(F.max("record"), F.max(F.abs("file"))).first()
    if size[0] is None:
        return _report(one, two, one.select(F.col("file").alias("tree"), F.col("record").alias("node")))
    depths = _depth(size[0] + 1), _depth(size[1] + 2)
    a, b = Tree(one, *depths), Tree(two, *depths)
    bad = _differing(a.files[-1], b.files[-1], "node")
    for x, y in zip(a.files[-2::-1], b.files[-2::-1], strict=True):
        bad = cut(_differing(_children(x, bad), _children(y, bad), "node"))
    roots = bad.select((F.col("node") - 1).alias("tree"), F.lit(0).cast("long").alias("node"))
    bad = roots
    for x, y in zip(a.records[-2::-1], b.records[-2::-1], strict=True):
        bad = cut(_differing(_children(x, bad, "tree"), _children(y, bad, "tree"), "tree", "node"))
    return _report(one, two, bad)


def _report(one: DataFrame, two: DataFrame, bad: DataFrame) -> DataFrame:
    at = bad.select(F.col("tree").alias("file"), F.col("node").alias("record"))
    columns = ("page_id", "start", "length", "digest")
    left = one.join(at, ["file", "record"], "left_semi").select("file", "record", *[F.col(c).alias(f"a_{c}") for c in columns])
    right = two.join(at, ["file", "record"], "left_semi").select("file", "record", *[F.col(c).alias(f"b_{c}") for c in columns])
    status = F.when(F.col("b_digest").isNull(), "missing").when(F.col("a_digest").isNull(), "extra").otherwise("changed")
    both = left.join(right, ["file", "record"], "full")
    return both.select("file", F.coalesce("a_page_id", "b_page_id").alias("page_id"), "record", F.coalesce("a_start", "b_start").alias("start"), F.coalesce("a_length", "b_length").alias("length"), F.col("a_digest").alias("digest"), F.col("b_digest").alias("other_digest"), status.alias("status"))


def manifest(one: DataFrame, two: DataFrame) -> DataFrame:
    """Every record of the first replica with its place and digest, and what the audit against the second says: `ok`, `changed` or `missing`; and the second's `extra` records."""
    one, two = cut(one), cut(two)
    found = _audit(one, two)
    same = one.join(found.select("file", "record"), ["file", "record"], "left_anti")
    return found.unionByName(same.select("file", "page_id", "record", "start", "length", "digest", F.col("digest").alias("other_digest"), F.lit("ok").alias("status")))
