import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusflow.llm import sharding


def test_digest(documents, rows):
    got = sharding.sharded_documents(documents).collect()
    said = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == said
    slots = defaultdict(list)
    shard = {}
    for r in got:
        slots[r.shard].append(r.slot)
        assert shard.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        assert 0 <= r.shard < 8 and r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_ranges_and_chunks_number_alike(spark, monkeypatch):
    df = spark.range(5000).select((F.col("id") % 900).alias("doc_id"), F.lit("x").alias("text"))
    whole = {tuple(r) for r in sharding.sharded_documents(df).collect()}
    monkeypatch.setattr(sharding, "SLOT_BUCKET_ROWS", 40)
    monkeypatch.setattr(sharding, "COPY_CHUNK", 2)
    assert {tuple(r) for r in sharding.sharded_documents(df).collect()} == whole


@pytest.mark.parametrize("shards", [1, 2, 31, 32, 33, 200])
def test_growth_moves_only_into_the_new_shard(spark, shards):
    keys = spark.range(4000).select(F.xxhash64("id").alias("h"))
    found = keys.select(
        sharding.jump_shard(F.col("h"), shards).alias("a"), sharding.jump_shard(F.col("h"), shards + 1).alias("b")
    ).collect()
    moved = [r for r in found if r.a != r.b]
    assert all(r.b == shards for r in moved) and all(0 <= r.a < shards for r in found)
    assert abs(len(moved) - 4000 / (shards + 1)) < 5 * (4000 / (shards + 1)) ** 0.5 + 1
    if shards <= 33:
        assert len({r.a for r in found}) == shards


def test_every_jump_is_made(spark, monkeypatch):
    keys = spark.range(2000).select(F.xxhash64("id").alias("h"))
    short = [r[0] for r in keys.select(sharding.jump_shard(F.col("h"), 50)).collect()]
    monkeypatch.setattr(sharding, "LIKELY_JUMPS", 2)
    assert [r[0] for r in keys.select(sharding.jump_shard(F.col("h"), 50)).collect()] == short


def test_no_rows(nothing):
    assert sharding.sharded_documents(nothing).count() == 0
