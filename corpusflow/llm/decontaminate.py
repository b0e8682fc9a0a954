"""Benchmark decontamination by winnowing.

Both sides hash their K-grams of words and keep the least hash of every WINDOW consecutive
ones. A window of SPAN = K + WINDOW - 1 words that stands in both keeps the same K-gram in
both, so every shared span of SPAN words is found through a kept K-gram. Each such hit is
extended to the whole window at its offset and compared word for word.

An item of fewer words is one window as a whole; its fingerprint is the hash of all of it,
and documents hash their runs of that length too. Windows of the benchmark are a table; the
matcher holds one block of them at a time, of at most BLOCK_WINDOWS rows, and the documents
pass once per block, so a benchmark of any size is matched in full.

Rows: a null or empty text has no words and hits nothing. A null item id marks words but is
not listed; a repeated item counts once. Each document row is judged by itself, so repeated
and null ids are no matter. Empty tables give no rows or no hits. Columns of the documents
that are called like a result column are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm import wordbytes
from corpusflow.llm.store import stored

SPAN = 10
K = 5
WINDOW = SPAN - K + 1
BLOCK_WINDOWS = 200_000
LOOKUP_BITS = 20

# Bytes that are no part of a word, after A-Z are lower case.
NO_WORD = [(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)]
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column("item_id").to_pylist(), wordbytes.texts_of(batch.column("text"))):
            words = WORD.findall(text.lower())
            found = [b" ".join(words[k : k + SPAN]) for k in range(max(1, len(words) - SPAN + 1))] if words else []
            for k in range(0, len(found), 10_000):
                part = found[k : k + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(part), pa.int64()), pa.array(part, pa.binary())], ["item_id", "words"]
                )


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """Each window of each item once: ``item_id``, ``words``."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return items.mapInArrow(_item_windows, "item_id long, words binary").distinct()


class Block:
    """Fingerprints of some windows, sorted, with what is needed to extend a hit."""

    def __init__(self, items: list, windows: list[bytes]):
        self.texts = sorted(set(windows))
        number = {w: k for k, w in enumerate(self.texts)}
        self.items: list[list] = [[] for _ in self.texts]
        for item, window in zip(items, windows):
            if item is not None:
                self.items[number[window]].append(item)
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        by_length: dict[int, list[tuple[int, int, int]]] = {}
        for k, window in enumerate(self.texts):
            words = wordbytes.Words([window], WORD_BYTES)
            hashes, n = words.hashes(), len(words.starts)
            if n == SPAN:
                grams = wordbytes.gram_hashes(hashes, K)
                offset = int(np.argmin(grams))
                by_length.setdefault(n, []).append((int(grams[offset]), offset, k))
            else:
                by_length.setdefault(n, []).append((int(wordbytes.gram_hashes(hashes, n)[0]), 0, k))
        for n, entries in by_length.items():
            entries.sort()
            prints = np.array([e[0] for e in entries], np.uint64)
            seen = np.zeros(1 << LOOKUP_BITS, bool)
            seen[prints & np.uint64(len(seen) - 1)] = True
            self.lengths[n] = (prints, np.array([e[1] for e in entries]), np.array([e[2] for e in entries]), seen)


WORD_BYTES = wordbytes.byte_class(NO_WORD)


def winnowed(grams: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Positions of the first least gram of each WINDOW grams, for windows marked in ``whole``."""
    m = len(whole)
    least, at = grams[:m].copy(), np.zeros(m, np.int64)
    for k in range(1, WINDOW):
        smaller = grams[k : k + m] < least
        least[smaller] = grams[k : k + m][smaller]
        at[smaller] = k
    return np.unique((np.arange(m) + at)[whole])


def _matches(words: wordbytes.Words, block: Block) -> Iterator[tuple[int, int, int]]:
    """Occurrences of windows: first word, number of words, window."""
    hashes = words.hashes()
    for n, (prints, offsets, windows, seen) in block.lengths.items():
        if len(hashes) < n:
            continue
        whole = words.doc[n - 1 :] == words.doc[: len(words.doc) - n + 1]
        if n == SPAN:
            grams = wordbytes.gram_hashes(hashes, K)
            at = winnowed(grams, whole)
        else:
            grams = wordbytes.gram_hashes(hashes, n)
            at = np.flatnonzero(whole)
        at = at[seen[grams[at] & np.uint64(len(seen) - 1)]]
        low, high = np.searchsorted(prints, grams[at], "left"), np.searchsorted(prints, grams[at], "right")
        hits = high - low
        entry = np.repeat(low - (np.cumsum(hits) - hits), hits) + np.arange(hits.sum())
        first = np.repeat(at, hits) - offsets[entry]
        fits = (first >= 0) & (first < len(whole))
        fits[fits] = whole[first[fits]]
        known: dict[int, bytes] = {}
        for start, window in zip(first[fits].tolist(), windows[entry[fits]].tolist()):
            if start not in known:
                known[start] = words.joined(start, n)
            if known[start] == block.texts[window]:
                yield start, n, window


def _judge(texts: list[bytes], block: Block) -> Iterator[tuple[int, np.ndarray, set]]:
    """Per text: its number of words, which of them are hit, and the items."""
    for low, high in wordbytes.chunks(texts):
        words = wordbytes.Words([t.lower() for t in texts[low:high]], WORD_BYTES)
        change = np.zeros(len(words.starts) + 1, np.int32)
        items: dict[int, set] = {}
        for start, n, window in _matches(words, block):
            change[start] += 1
            change[start + n] -= 1
            items.setdefault(int(words.doc[start]), set()).update(block.items[window])
        hit = np.cumsum(change[:-1]) > 0
        ends = np.cumsum(words.count)
        for k in range(high - low):
            yield int(words.count[k]), hit[ends[k] - words.count[k] : ends[k]], items.get(k, set())


RESULT = ["n_words", "n_hit", "items", "_hit_bits"]


def _pass(block_rows, keep_text: bool, first: bool):
    """One pass over the documents with one block of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(*block_rows.value)
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            texts = wordbytes.texts_of(columns["text"])
            if not keep_text:
                del columns["text"]
            told = [columns.pop(n).to_pylist() for n in ("_hit_bits", "items")] if not first else None
            n_words, n_hit, found, bits = [], [], [], []
            for k, (n, hit, items) in enumerate(_judge(texts, block)):
                if told and told[0][k] is not None:
                    hit = hit | np.unpackbits(np.frombuffer(told[0][k], np.uint8), count=n).astype(bool)
                    items = items | set(told[1][k])
                n_words.append(n)
                n_hit.append(int(hit.sum()))
                found.append(sorted(items))
                bits.append(np.packbits(hit).tobytes() if n_hit[-1] else None)
            columns |= {
                "n_words": pa.array(n_words, pa.int64()),
                "n_hit": pa.array(n_hit, pa.int64()),
                "items": pa.array(found, pa.list_(pa.int64())),
                "_hit_bits": pa.array(bits, pa.binary()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def mark_contaminated(documents: DataFrame, benchmark: DataFrame, keep_text: bool = True) -> DataFrame:
    """``documents`` with n_words, n_hit (words in shared windows) and items (their sorted ids)."""
    spark = documents.sparkSession
    windows = stored(benchmark_windows(benchmark), "benchmark-windows")
    blocks = max(1, -(-windows.count() // BLOCK_WINDOWS))
    numbered = windows.withColumn("_block", F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)))
    marked = documents.drop(*RESULT).withColumn("text", F.col("text").cast("string"))
    plain = marked.schema
    added = T.StructType.fromDDL("n_words long, n_hit long, items array<long>, _hit_bits binary")
    for k in range(blocks):
        rows = numbered.filter(F.col("_block") == k).select("item_id", "words").toPandas()
        part = spark.sparkContext.broadcast((rows["item_id"].astype(object).where(rows["item_id"].notna(), None).tolist(), [bytes(w) for w in rows["words"]]))
        keep = keep_text or k + 1 < blocks
        kept = [f for f in plain.fields if keep or f.name != "text"]
        marked = marked.drop("n_words", "n_hit").mapInArrow(_pass(part, keep, k == 0), T.StructType(kept + added.fields))
        if k + 1 < blocks:
            marked = stored(marked, "benchmark-pass")
    return marked.drop("_hit_bits")


def contamination_digest(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    marked = mark_contaminated(documents.select("doc_id", "text"), benchmark, keep_text=False)
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
