"""Near-duplicate documents by SimHash fingerprints.

A fingerprint has 64 bits: bit k is set if it is set in over half of the hashes of the
text's word shingles. Fingerprints that differ in at most 3 bits are linked. By the
pigeonhole principle such a pair agrees on at least 3 of 6 blocks, so each fingerprint is
filed under the 20 choices of 3 blocks (32 bits on average), filed pairs are joined and
their Hamming distance is verified in the join, each pair under its first common choice only.

Copies share a fingerprint and are one node. A file of more than FULL_FILE fingerprints is
not paired: each member is filed again under all values at distance 0 to 2 of it within the
open bits. A pair at distance 3 or less has a value at distance 1 or less of one and 2 or
less of the other; linking all members at such a value to one at distance 1 or less makes
links of 3 bits at most, and as many as needed for the same components.

Rows: a null or empty text has fingerprint 0 and is linked like any other. Rows are judged by
their text alone; a null id is never a component's id unless the component has no other id. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import graph, wordbytes
from corpusflow.llm.store import stored

SHINGLE = 3
SEED = 42
DISTANCE = 3
# 6 blocks as (first bit, bits).
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
CHOICES = list(itertools.combinations(range(len(BLOCKS)), len(BLOCKS) - DISTANCE))
FULL_FILE = 1000


def fingerprint(text: bytes) -> int:
    """SimHash of a UTF-8 text, unsigned."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE))))
    hashes = np.array(list(map(functools.partial(xxhash.xxh64_intdigest, seed=SEED), grams)), np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
    over = 2 * bits.sum(0, dtype=np.int64) > len(hashes)
    return int(np.packbits(over, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t) for t in wordbytes.texts_of(batch.column("text"))], np.uint64)
        kept = [n for n in batch.schema.names if n != "text"]
        columns = [batch.column(n) for n in kept] + [pa.array(found.view(np.int64), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, [*kept, "fp"])


def fingerprints(documents: DataFrame, *more: Column) -> DataFrame:
    """``doc_id``, further columns and ``fp`` (the 64 bits as a signed number)."""
    rows = documents.select("doc_id", *more, F.col("text").cast("string").alias("text"))
    kept = [f"{n} {t}" for n, t in rows.dtypes if n != "text"]
    return rows.mapInArrow(_fingerprints, ", ".join([*kept, "fp long"]))


def _mask(choice: tuple[int, ...]) -> int:
    value = sum(((1 << BLOCKS[b][1]) - 1) << BLOCKS[b][0] for b in choice)
    return value - (1 << 64) if value >= 1 << 63 else value


MASKS = [_mask(c) for c in CHOICES]


def _first_common(a: Column, b: Column) -> Column:
    """The first choice of blocks on which two fingerprints agree."""
    different = a.bitwiseXOR(b)
    first = F.lit(len(MASKS))
    for k in reversed(range(len(MASKS))):
        first = F.when(different.bitwiseAND(F.lit(MASKS[k])) == 0, k).otherwise(first)
    return first


def _paired(files: DataFrame) -> DataFrame:
    a, b = files.alias("x"), files.alias("y")
    x, y = F.col("x.fp"), F.col("y.fp")
    return a.join(
        b,
        (F.col("x.choice") == F.col("y.choice"))
        & (F.col("x.file") == F.col("y.file"))
        & (x < y)
        & (F.bit_count(x.bitwiseXOR(y)) <= DISTANCE)
        & (_first_common(x, y) == F.col("x.choice")),
    ).select(x.alias("a"), y.alias("b"))


def _starred(files: DataFrame) -> DataFrame:
    """Links of full files through values at distance 1 and 2; rows grow with the members."""
    spark = files.sparkSession
    near = []
    for k, mask in enumerate(MASKS):
        free = [1 << bit for bit in range(64) if not mask >> bit & 1]
        near += [(k, 0, 0), *((k, 1, f) for f in free), *((k, 2, f | g) for f, g in itertools.combinations(free, 2))]
    near = [(k, d, m - (1 << 64) if m >= 1 << 63 else m) for k, d, m in near]
    flips = spark.createDataFrame(near, "choice int, far int, flip long")
    filed = files.join(F.broadcast(flips), "choice").select(
        "choice", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"), "fp", "far"
    )
    return (
        filed.groupBy("choice", "value")
        .agg(F.min(F.when(F.col("far") <= 1, F.col("fp"))).alias("a"), F.collect_set("fp").alias("_all"))
        .filter("a IS NOT NULL AND size(_all) > 1")
        .select("a", F.explode("_all").alias("b"))
    )


def links(prints: DataFrame, full_file: int = FULL_FILE) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints ``fp``, enough for the components."""
    choice = F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in MASKS)))
    files = prints.select("fp", choice.alias("choice", "file"))
    sizes = files.groupBy("choice", "file").agg(F.count(F.lit(1)).alias("n"))
    full = stored(sizes.filter(F.col("n") > full_file), "full-files")
    if full.isEmpty():
        return _paired(files)
    keys = ["choice", "file"]
    return _paired(files.join(full, keys, "left_anti")).union(_starred(files.join(full, keys, "left_semi")))


def with_components(prints: DataFrame, full_file: int = FULL_FILE) -> DataFrame:
    """Rows of doc_id and fp with ``component_id``: the least id that can be reached.

    ``prints`` is read several times; hand in a stored table.
    """
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("_least")), "simhash-nodes")
    roots = graph.components(links(nodes.select("fp"), full_file))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "_least", F.coalesce("root", "fp").alias("root")
    )
    rooted = stored(rooted, "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp")


def simhash_digest(documents: DataFrame) -> DataFrame:
    prints = stored(fingerprints(documents), "simhash")
    return with_components(prints).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(documents: DataFrame) -> DataFrame:
    """One row of each component, that with the least id; columns as they were."""
    identity = F.xxhash64("doc_id", F.col("text").cast("string"))
    prints = stored(fingerprints(documents, identity.alias("_row")), "simhash")
    stays = (
        with_components(prints)
        .groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("_alone"))
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("_one"))
        .select("_one._row")
    )
    rows = documents.select(F.struct(*documents.columns).alias("_document"), identity.alias("_row"))
    return rows.join(stays, "_row", "left_semi").dropDuplicates(["_row"]).select("_document.*")
