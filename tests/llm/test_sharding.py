from __future__ import annotations

import zlib
from collections import defaultdict

import pytest

from recallbase.llm import sharding

from .conftest import DOC, doc_row, words


def check(rows, got, shards):
    want = sorted((-99 if r[0] is None else r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((-99 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in got:
        assert r.law == "bytes" and 0 <= r.shard < shards and r.grown_shard is None
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_odd_rows_and_empty_tables(odd, odd_rows, empty):
    check(odd_rows, sharding.assign(odd, 16).collect(), 16)
    assert sharding.assign(empty, 16).count() == 0


@pytest.fixture(scope="module")
def many(spark, rng):
    rows = [doc_row(i, words(rng, rng.randint(1, 40)) if i % 3 else "one text that a third of all rows have") for i in range(6000)]
    return rows, spark.createDataFrame(rows, DOC).repartition(5).cache()


def test_bytes_are_nearly_equal(many):
    rows, df = many
    sizes = check(rows, sharding.assign(df, 16).collect(), 16)
    assert len(sizes) == 16 and max(sizes.values()) <= 1.02 * min(sizes.values())


def slotted(df):
    return sharding.numbered(sharding.sized(df))


def test_nulls_and_repeats_do_not_crowd_a_slot(spark, rng, monkeypatch):
    """A third of all rows have no id, and as many are one row again and again."""
    monkeypatch.setattr(sharding, "RUN", 100)
    rows = [doc_row(i, words(rng, rng.randint(5, 20))) for i in range(2000)] + [doc_row(None, words(rng, rng.randint(5, 20))) for _ in range(2000)] + [doc_row(7, "the same row")] * 2000
    sizes = check(rows, sharding.assign(spark.createDataFrame(rows, DOC), 16).collect(), 16)
    assert len(sizes) == 16 and max(sizes.values()) <= 1.02 * min(sizes.values())


def spread(mapped):
    sums = defaultdict(int)
    for r in mapped:
        sums[r.shard] += r.bytes
    return sums


def test_growing_moves_a_share_to_the_new_shard_alone(many):
    _, df = many
    one = sharding.new_map(sharding.slot_bytes(slotted(df)), 8)
    two = sharding.grow(one, 8)
    a, b = {r.vslot: r for r in one.collect()}, {r.vslot: r for r in two.collect()}
    moved = [s for s in a if a[s].shard != b[s].shard]
    assert set(a) == set(b) and moved and all(b[s].shard == 8 for s in moved) and {r.version for r in b.values()} == {2}
    sums = spread(b.values())
    assert len(sums) == 9 and max(sums.values()) < 1.2 * min(sums.values())


def test_rebalancing_moves_only_what_it_must(many, spark, rng):
    _, df = many
    old = sharding.new_map(sharding.slot_bytes(slotted(df)), 8)
    more = df.unionByName(spark.createDataFrame([doc_row(i, words(rng, 60)) for i in range(10_000, 11_500)], DOC))
    slots = sharding.slot_bytes(slotted(more))
    a, b = {r.vslot: r.shard for r in old.collect()}, sharding.rebalance(old, slots, 8).collect()
    assert {r.vslot for r in b} == {r.vslot for r in slots.collect()} and {r.version for r in b} == {2}
    sums = spread(b)
    assert max(sums.values()) <= 1.05 * min(sums.values())
    assert sum(r.vslot in a and a[r.vslot] != r.shard for r in b) < 0.3 * len(b)


def test_written_shards_and_versions(many, spark, tmp_path):
    rows, df = many
    mapped = sharding.new_map(sharding.slot_bytes(slotted(df)), 4).cache()
    sharding.write_shards(df, mapped, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == len(rows) and set(DOC.replace(" long", "").replace(" string", "").replace(" double", "").replace(" int", "").split(", ")) <= set(back.columns)
    sharding.store_map(mapped, str(tmp_path / "map"))
    sharding.store_map(sharding.grow(mapped, 4), str(tmp_path / "map"))
    assert {r.version for r in spark.read.parquet(str(tmp_path / "map")).select("version").distinct().collect()} == {1, 2}
