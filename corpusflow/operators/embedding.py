"""Vectors of texts by feature hashing: signed n-gram counts under a seeded random projection.

Each word and each pair of adjacent words is hashed to one of ``buckets`` with a sign; the sums
per bucket are projected by a fixed matrix of 1 and -1 to ``width`` numbers and scaled to length
1. Nothing is learned, so a text's vector depends on the text and the parameters alone. All sums
are of whole numbers, hence exact in any order.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.corpus import word_list


def projection(width: int, buckets: int, seed: int) -> np.ndarray:
    """Signs by bucket and dimension: 1 where the MD5 of ``seed:bucket:dimension`` begins below 8."""
    side = lambda b, d: 1 if hashlib.md5(f"{seed}:{b}:{d}".encode()).digest()[0] < 128 else -1
    return np.array([[side(b, d) for d in range(width)] for b in range(buckets)], np.int8).reshape(buckets, width)


def _sums(text: bytes | None, signs: np.ndarray) -> np.ndarray:
    """The projected counts of one text, given as words with a line break between."""
    words = text.split(b"\n") if text else []
    grams = Counter(words)
    grams.update(map(b" ".join, zip(words, words[1:])))
    digests = np.frombuffer(b"".join(hashlib.md5(g).digest() for g in grams), np.uint8).reshape(-1, 16)
    bucket = np.ascontiguousarray(digests[:, :4]).view(">u4").ravel().astype(np.int64) % len(signs)
    signed = np.fromiter(grams.values(), np.int64, len(grams)) * np.where(digests[:, 4] < 128, 1, -1)
    return np.bincount(bucket, signed, len(signs)) @ signs


def _vectors(signs: np.ndarray):
    def embed(batches):
        wide = signs.astype(np.float64)
        for batch in batches:
            sums = np.array([_sums(t.as_py(), wide) for t in batch.column("_words")]).reshape(-1, wide.shape[1])
            size = np.sqrt((sums**2).sum(1, keepdims=True))
            unit = np.divide(sums, size, out=np.zeros_like(sums), where=size > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(unit), pa.list_(pa.float64()))], [batch.schema.names[0], "vector"])

    return embed


def embed_text(
    df: DataFrame, key: str, text: str = "text", width: int = 64, buckets: int = 4096, seed: int = 0
) -> DataFrame:
    """``key`` and ``vector`` (``width`` doubles of length 1) of each text.

    A text without words, or null, has the zero vector. A text is hashed, summed and projected
    where it lies, so nothing is shuffled; each task holds the signs, ``buckets`` times ``width``.
    """
    words = F.array_join(F.transform(word_list(text), F.lower), "\n").cast("binary")
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, words.alias("_words")).mapInArrow(
        _vectors(projection(width, buckets, seed)), f"`{key}` {kind}, vector array<double>"
    )
