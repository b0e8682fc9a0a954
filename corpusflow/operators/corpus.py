"""Chunks, sentences, token counts, class metrics, scaling, n-gram and subsequence overlap of texts.

Expressions and aggregates, but for the overlap of two texts, which is counted row by row. Words are runs of anything but blanks, tabs and line breaks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

SPACES = r"[ \t\n\r]+"
BREAK = "\x1e"  # between sentences while they are cut


def word_list(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), SPACES, -1), "")


def chunk_text(df: DataFrame, size: int, overlap: int = 0, text: str = "text") -> DataFrame:
    """One row per run of ``size`` words, each sharing ``overlap`` words with the one before.

    Adds ``chunk`` (from 0) and ``chunk_text``, words joined by blanks. A text of at most
    ``size`` words is one chunk, a text without words none.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    step = size - overlap
    words = df.withColumn("_words", word_list(text)).where(F.size("_words") > 0)
    last = F.ceil(F.greatest(F.size("_words") - size, F.lit(0)) / step).cast("int")
    placed = words.withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    run = F.slice("_words", F.col("chunk") * step + 1, F.lit(size))
    return placed.withColumn("chunk_text", F.array_join(run, " ")).drop("_words")


def split_sentences(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per sentence: ``position`` and ``sentence``.

    A sentence ends with ``.``, ``!`` or ``?`` in front of white space.
    """
    marked = F.regexp_replace(F.col(text), rf"([.!?]+){SPACES}", f"$1{BREAK}")
    pieces = F.array_remove(F.split(marked, BREAK, -1), "")
    return df.select("*", F.posexplode(pieces).alias("position", "sentence"))


def token_stats(df: DataFrame, group: Sequence[str], text: str = "text") -> DataFrame:
    """Texts, words, and least, mean and most words of a text, per group."""
    counted = df.withColumn("_n", F.size(word_list(text)))
    return counted.groupBy(*group).agg(
        F.count(F.lit(1)).alias("texts"),
        F.sum("_n").alias("tokens"),
        F.min("_n").alias("fewest"),
        F.avg("_n").alias("mean"),
        F.max("_n").alias("most"),
    )


def classification_metrics(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of each class that occurs on either side.

    Rows with a null on one side are left out; a share of nothing is 0.
    """
    pairs = df.where(F.col(gold).isNotNull() & F.col(predicted).isNotNull())
    cells = pairs.groupBy(F.col(gold).alias("_g"), F.col(predicted).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    sides = F.array(
        F.struct(F.col("_g").alias("label"), F.lit(True).alias("_gold")),
        F.struct(F.col("_p").alias("label"), F.lit(False).alias("_gold")),
    )
    both = cells.withColumn("_hit", F.col("_g") == F.col("_p")).select("*", F.inline(sides))
    n = F.col("_n")
    sums = both.groupBy("label").agg(
        F.sum(F.when(F.col("_gold") & F.col("_hit"), n).otherwise(0)).alias("hits"),
        F.sum(F.when(~F.col("_gold"), n).otherwise(0)).alias("claimed"),
        F.sum(F.when(F.col("_gold"), n).otherwise(0)).alias("support"),
    )
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    hits, claimed, support = F.col("hits"), F.col("claimed"), F.col("support")
    return sums.select(
        "label",
        share(hits, claimed).alias("precision"),
        share(hits, support).alias("recall"),
        share(2 * hits, claimed + support).alias("f1"),
        "support",
    )


def _scaled(df: DataFrame, columns: Sequence[str], low, width) -> DataFrame:
    """(value - low) / width with both measured over the table; 0 where width is 0."""
    wanted = [f(c) for c in columns for f in (low, width)]
    found = list(df.agg(*wanted).first())
    out = {}
    for c, base, span in zip(columns, found[::2], found[1::2]):
        moved = F.col(c) - F.lit(base)
        out[c] = moved / F.lit(float(span)) if span else moved * 0.0
    return df.withColumns(out)


def min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns moved to 0..1 by their least and greatest value."""
    return _scaled(df, columns, F.min, lambda c: F.max(c) - F.min(c))


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns with mean 0 and population deviation 1."""
    return _scaled(df, columns, F.avg, F.stddev_pop)


def _shared_grams(n: int):
    """Shared and own n-grams of two texts given as words with a line break between."""

    def grams(text: bytes | None) -> Counter:
        words = text.split(b"\n") if text else []
        return Counter(words if n == 1 else zip(*(words[k:] for k in range(n))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for c, r in zip(batch.column("_c"), batch.column("_r")):
                claimed, wanted = grams(c.as_py()), grams(r.as_py())
                less, more = sorted((claimed, wanted), key=len)
                both = sum(min(times, more[gram]) for gram, times in less.items() if gram in more)
                found.append((both, claimed.total(), wanted.total()))
            told = [pa.array([f[i] for f in found], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *told], [batch.schema.names[0], "_both", "_claimed", "_wanted"])

    return count


def _shares(sums: DataFrame, key: str) -> DataFrame:
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    both, claimed, wanted = F.col("_both"), F.col("_claimed"), F.col("_wanted")
    return sums.select(
        key,
        share(both, claimed).alias("precision"),
        share(both, wanted).alias("recall"),
        share(2 * both, claimed + wanted).alias("f1"),
    )


def rouge(df: DataFrame, key: str, candidate: str, reference: str, n: int = 1) -> DataFrame:
    """Precision, recall and F1 of shared n-grams per row, lower case, counted with repeats.

    The two texts of a row are counted where they lie: the work is linear in the text and nothing
    is shuffled.
    """
    words = lambda c: F.array_join(F.transform(word_list(c), F.lower), "\n").cast("binary")
    sides = df.select(key, words(candidate).alias("_c"), words(reference).alias("_r"))
    kind = df.schema[key].dataType.simpleString()
    return _shares(sides.mapInArrow(_shared_grams(n), f"`{key}` {kind}, _both long, _claimed long, _wanted long"), key)


LCS_BLOCK = 4096


def common_subsequence(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence of two sequences, bit-parallel.

    Bits of ``row`` that are 0 mark the places of ``a`` where the length grows; each item of
    ``b`` moves them by one addition. ``a`` is taken in blocks of LCS_BLOCK places, whose
    carries, one for each item of ``b``, pass to the next block: len(a) * len(b) / 64 machine
    words of work, and LCS_BLOCK * LCS_BLOCK / 8 + len(b) bytes at most.
    """
    length = 0
    carries = bytearray(len(b))
    for at in range(0, len(a), LCS_BLOCK):
        places: dict = {}
        for k, item in enumerate(a[at : at + LCS_BLOCK]):
            places[item] = places.get(item, 0) | 1 << k
        size = min(LCS_BLOCK, len(a) - at)
        full = (1 << size) - 1
        row = full
        for j, item in enumerate(b):
            held = places.get(item, 0) & row
            if held or carries[j]:
                moved = row + held + carries[j]
                carries[j] = moved >> size
                row = (moved | (row & ~held)) & full
        length += size - row.bit_count()
    return length


def _subsequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("_c"), batch.column("_r"))
        found = [common_subsequence(c.as_py() or [], r.as_py() or []) for c, r in pairs]
        sizes = [[len(x) if x.is_valid else 0 for x in batch.column(n)] for n in ("_c", "_r")]
        columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (found, *sizes))]
        yield pa.RecordBatch.from_arrays(columns, [batch.schema.names[0], "_both", "_claimed", "_wanted"])


def rouge_l(df: DataFrame, key: str, candidate: str, reference: str) -> DataFrame:
    """Precision, recall and F1 of the longest common subsequence of lower-case words per ``key``.

    A text without words, or null, shares nothing.
    """
    words = lambda c: F.transform(word_list(c), F.lower)
    sides = df.select(key, words(candidate).alias("_c"), words(reference).alias("_r"))
    kind = df.schema[key].dataType.simpleString()
    return _shares(sides.mapInArrow(_subsequences, f"`{key}` {kind}, _both long, _claimed long, _wanted long"), key)


def build_vocab(df: DataFrame, size: int, text: str = "text") -> DataFrame:
    """``word``, ``id``, ``n``: the ``size`` most frequent words, equal counts by word.

    Ids start at 2; 0 is padding and 1 stands for every other word. Counting combines before
    the shuffle; only the ``size`` rows that stay are numbered together.
    """
    counts = df.select(F.explode(word_list(text)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    order = [F.desc("n"), F.asc("word")]
    most = counts.orderBy(*order).limit(size)
    return most.select("word", (F.row_number().over(Window.orderBy(*order)) + 1).alias("id"), "n")


def vocab_encoder(vocab: DataFrame):
    """A loader for ``encode_text`` over a table of :func:`build_vocab`, which bounds what is collected."""
    ids = {r.word: r.id for r in vocab.select("word", "id").collect()}

    def load():
        def encode(texts: Sequence[str]) -> list[list[int]]:
            return [[ids.get(w, 1) for w in re.split(SPACES, t) if w] for t in texts]

        return encode

    return load
