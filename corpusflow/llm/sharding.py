"""Jump consistent hashing: stable keys to shards without a ring table.

Lamping and Veach's jump hash walks the bucket numbers at which a growing number of shards
would move a key, and stops at the last one below the number of shards. Adding a shard can
only add a jump into the new shard, so a row stays where it is or moves into that shard.
The draw of each jump is XXH64 of key hash and bucket in place of their congruential step,
which keeps the arithmetic free of overflow.

Rows: any column may be null. A null key is a key like any other. Equal rows (same key,
same text) get neighbouring slots. An empty table gives no rows. Columns of the input that
are called like a result column are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.store import stored

LIKELY_JUMPS = 32  # about ln(shards) jumps are made; rows with more take the long walk
SLOT_BUCKET_ROWS = 100_000
COPY_CHUNK = 10_000


def jump_shard(key_hash: Column, shards: int) -> Column:
    """The shard, 0 to ``shards - 1``, of a 64-bit key hash."""

    def step(state: Column, _: Column) -> Column:
        at = state["next"]
        draw = F.shiftrightunsigned(F.xxhash64(key_hash, at), 33) + 1
        jump = F.floor((at + 1) * (2.0**31 / draw.cast("double"))).cast("long")
        return F.when(at >= shards, state).otherwise(F.struct(at.alias("shard"), jump.alias("next")))

    begin = F.struct(F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("next"))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, LIKELY_JUMPS))), begin, step)
    if shards > LIKELY_JUMPS:
        whole = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), begin, step)
        walk = F.when(walk["next"] >= shards, walk).otherwise(whole)
    return walk["shard"].cast("int")


def assign_shards(df: DataFrame, key: str, shards: int) -> DataFrame:
    """Add ``shard`` and ``grown_shard`` (with one shard more). No shuffle."""
    hashed = F.xxhash64(F.col(key))
    return df.withColumn("shard", jump_shard(hashed, shards)).withColumn(
        "grown_shard", jump_shard(hashed, shards + 1)
    )


def number_slots(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``slot``, from 0 without a gap in each ``shard``, by hash of ``columns``.

    ``df`` has ``shard`` and ``columns``, which hold all that the result needs. Equal rows
    are counted first and dealt out in chunks, and the hash order is cut into ranges that
    are numbered apart, so no key, shard or group of copies is one task's work.
    """
    counted = stored(df.groupBy("shard", *columns).agg(F.count(F.lit(1)).alias("_n")), "slots")
    bits = max(0, math.ceil(math.log2(max(1, counted.count() / SLOT_BUCKET_ROWS))))
    chunks = F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / COPY_CHUNK)))
    order = F.xxhash64(*columns)
    rows = counted.select("*", order.alias("_order"), chunks.alias("_chunk")).select(
        "*",
        (F.shiftright("_order", 64 - bits) if bits else F.lit(0).cast("long")).alias("_range"),
        F.least(F.lit(COPY_CHUNK), F.col("_n") - F.col("_chunk") * COPY_CHUNK).alias("_m"),
    )
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("shard", "_range").agg(F.sum("_m").alias("_rows"))
    ranges = ranges.select("shard", "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"))
    inside = (
        Window.partitionBy("shard", "_range")
        .orderBy("_order", *columns, "_chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = rows.withColumn("_at", F.coalesce(F.sum("_m").over(inside), F.lit(0)))
    placed = placed.join(ranges, ["shard", "_range"])
    first = F.col("_first") + F.col("_at")
    return placed.select(
        "shard", *columns, F.explode(F.sequence(first, first + F.col("_m") - 1)).alias("slot")
    )


def sharded_documents(documents: DataFrame, shards: int = 8) -> DataFrame:
    """Digest of a sharded table: one row per document with size, CRC, shard and slot."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = documents.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    placed = number_slots(assign_shards(sized, "doc_id", shards), ["doc_id", "size", "text_crc32", "grown_shard"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
