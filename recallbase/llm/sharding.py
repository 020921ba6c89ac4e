"""Sharding over fixed virtual slots, with a versioned map from slots to shards.

A record's virtual slot is fixed by its doc_id, text checksum, size and, among equals of all three, its number: the first
hexadecimal digits of the MD5 of these as text. So neither an id nor a null that a third of all rows share, nor rows that
are equal throughout, crowd a slot. Copies of a text under different ids are records like any other: the method deals
records, it doesn't keep groups of equal texts together, and a large group is spread over all shards. Bytes are aggregated
per slot and the slots, largest first, each go to the shard with the fewest bytes so far (law `bytes`). The
map is a table of VSLOTS rows a version; rebalancing and growing edit the map, so only records of the slots that
moved change their shard. Everything here is DataFrame functions; nothing but sums per slot is gathered.

A record's place in its shard is gapless from 0. It is the number of records in the shard's earlier buckets (a bucket is
a slot's share of further MD5 digits, 65,536 in all, so none is large) plus its rank in its own bucket.

Nulls and ties: a null text has 0 bytes and the crc32 of an empty text; a null doc_id counts as an empty one; rows that
are equal in id, checksum and size are numbered and dealt one by one (`write_shards`, which moves whole records, puts them
where the first is). Extra columns are ignored by `assign` and kept by
`write_shards`. An empty table gives an empty map and no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallbase.llm.common import cut

#: Hexadecimal digits of the MD5 that make a slot (4096 slots) and a bucket within it; equal rows that one task numbers.
SLOT_DIGITS, BUCKET_DIGITS, RUN = 3, 4, 65_536
_RECORD = ("doc_id", "size", "text_crc32")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 of every row."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"))


def _key(crc: Column, size: Column, copy: Column) -> Column:
    return F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), crc, size, copy)


def _slot(key: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, digits), 16, 10).cast("int")


def numbered(rows: DataFrame) -> DataFrame:
    """rows of `sized` with copy (the number among equal rows, from 0), vslot and bucket. Equal rows are counted, and the count unrolled in many tasks."""
    groups = cut(rows.groupBy(*_RECORD).agg(F.count("*").alias("n")))
    once = groups.where("n = 1").select(*_RECORD, F.lit(0).cast("long").alias("copy"))
    runs = groups.where("n > 1").select(*_RECORD, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {RUN}"))).alias("run")).repartition(*_RECORD, "run")
    more = runs.select(*_RECORD, F.explode(F.sequence(F.col("run") * RUN, F.least("n", (F.col("run") + 1) * RUN) - 1)).alias("copy"))
    key = _key(F.col("text_crc32"), F.col("size"), F.col("copy"))
    return once.unionByName(more).select("*", _slot(key, SLOT_DIGITS).alias("vslot"), _slot(key, BUCKET_DIGITS).alias("bucket"))


def slot_bytes(rows: DataFrame) -> DataFrame:
    """Bytes and rows per virtual slot: at most 4096 rows, whatever the corpus."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def new_map(slots: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """version, vslot, shard, bytes: the slots from the largest down, each to the shard with the fewest bytes so far (ties: lower slot, lower shard).

    One fold over an array of at most 4096 slots.
    """
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct("bytes", (-F.col("vslot")).alias("minus")))))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("load"), F.array().cast("array<struct<vslot:int,shard:int,bytes:bigint>>").alias("put"))

    def place(state: Column, slot: Column) -> Column:
        at = (F.array_position(state["load"], F.array_min(state["load"])) - 1).cast("int")
        load = F.transform(state["load"], lambda v, i: F.when(i == at, v + slot["bytes"]).otherwise(v))
        put = F.concat(state["put"], F.array(F.struct((-slot["minus"]).alias("vslot"), at.alias("shard"), slot["bytes"].alias("bytes"))))
        return F.struct(load.alias("load"), put.alias("put"))

    packed = slots.groupBy().agg(ordered.alias("slots")).select(F.explode(F.aggregate("slots", start, place)["put"]).alias("p"))
    return packed.select(F.lit(version).alias("version"), "p.vslot", "p.shard", "p.bytes")


def grow(mapped: DataFrame, shards: int) -> DataFrame:
    """The next version of the map, with shard number `shards` added: each old shard gives up slots of about 1 / (shards + 1) of its bytes, and only to the new one.

    Smallest slots go first, so that the bytes given are close to the share.
    """
    by_size = Window.partitionBy("shard").orderBy("bytes", "vslot")
    share = F.sum("bytes").over(Window.partitionBy("shard")) / F.lit(shards + 1)
    moved = F.sum("bytes").over(by_size) <= share
    return mapped.select((F.col("version") + 1).alias("version"), "vslot", F.when(moved, F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"), "bytes")


def rebalance(mapped: DataFrame, slots: DataFrame, shards: int) -> DataFrame:
    """The next version of the map for new sums per slot. A shard above the mean gives up its smallest slots while it stays above; these alone are dealt anew, to the shards with the most room, largest first.

    New slots are dealt like those given up. Moves only what is needed; a fresh map may be more even.
    """
    now = slots.select("vslot", "bytes").join(F.broadcast(mapped.select("vslot", "shard", "version")), "vslot", "left")
    mean = F.sum("bytes").over(Window.partitionBy()) / F.lit(shards)
    large = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot")
    kept = F.col("shard").isNotNull() & ((F.sum("bytes").over(large) <= mean) | (F.row_number().over(large) == 1))
    staged = now.withColumn("keep", kept)
    loads = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.aggregate(F.filter("all", lambda s: s["keep"] & (s["shard"] == i)), F.lit(0).cast("long"), lambda a, s: a + s["bytes"]))
    start = F.struct(loads.alias("load"), F.array().cast("array<struct<vslot:int,shard:int,bytes:bigint>>").alias("put"))

    def place(state: Column, slot: Column) -> Column:
        at = F.when(slot["keep"], slot["shard"]).otherwise((F.array_position(state["load"], F.array_min(state["load"])) - 1).cast("int"))
        load = F.transform(state["load"], lambda v, i: F.when(~slot["keep"] & (i == at), v + slot["bytes"]).otherwise(v))
        return F.struct(load.alias("load"), F.concat(state["put"], F.array(F.struct(slot["vslot"].alias("vslot"), at.alias("shard"), slot["bytes"].alias("bytes")))).alias("put"))

    ordered = F.reverse(F.array_sort(F.collect_list(F.struct("bytes", "vslot", "shard", "keep"))))
    packed = staged.groupBy().agg(ordered.alias("all"), (F.max("version") + 1).alias("version")).select("version", F.explode(F.aggregate("all", start, place)["put"]).alias("p"))
    return packed.select(F.coalesce("version", F.lit(1)).alias("version"), "p.vslot", "p.shard", "p.bytes")


def store_map(mapped: DataFrame, folder: str) -> None:
    """Adds this version to the table of versions."""
    mapped.coalesce(1).write.mode("append").partitionBy("version").parquet(folder)


def placed(rows: DataFrame, mapped: DataFrame) -> DataFrame:
    """rows of `numbered` with shard and slot, the place in the shard."""
    chosen = F.broadcast(mapped.select("vslot", "shard"))  # at most 4096 rows
    counts = rows.groupBy("vslot", "bucket").agg(F.count("*").alias("n")).join(chosen, "vslot")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")
    base = F.broadcast(counts.select("bucket", "shard", before.alias("before")))  # at most 65,536 rows
    own = Window.partitionBy("bucket").orderBy("doc_id", "text_crc32", "size", "copy")
    return rows.join(base, "bucket").withColumn("slot", F.col("before") + F.row_number().over(own) - 1)


def assign(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot of every row, under law `bytes` (grown_shard is null)."""
    rows = numbered(sized(docs))
    mapped = cut(new_map(slot_bytes(rows), shards))
    return placed(rows, mapped).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


def write_shards(docs: DataFrame, mapped: DataFrame, folder: str) -> None:
    """Writes the records themselves, a folder a shard, each slot's records together."""
    chosen = F.broadcast(mapped.select(F.col("vslot").alias("_vslot"), F.col("shard").alias("_shard")))
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = _key(F.crc32(raw), F.octet_length(raw).cast("long") + 1, F.lit(0))
    docs.withColumn("_vslot", _slot(key, SLOT_DIGITS)).join(chosen, "_vslot").repartition("_vslot").sortWithinPartitions("_shard", "_vslot").write.partitionBy("_shard").parquet(folder)
