"""Cleaning, prompt building, validation, concatenation, splitting and batching."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from corpusflow.functions import text as X
from corpusflow.operators.ordinal import aligned_ordinal, keys_at, rank_slice, tail_where

# Payload limit in base64 characters, rejection code and wording.
PAYLOAD_LIMIT = 900_000
REJECT_CODE = 400
NO_QUESTION = "question cannot be empty"
NO_CONTEXT = "context (CREATE TABLE) cannot be empty"

SPLITS = ("train", "val", "test")
ENCODED_ROWS = 128  # texts in one call of an encoder
PREFIX_ROWS = 50_000  # rows that share a hash prefix, about


def clean_rows(df: DataFrame, column: str = "text") -> DataFrame:
    """Drop rows holding any null; ``column`` must be among the columns."""
    return df.na.drop("any").where(F.col(column).isNotNull())


def to_pairs(df: DataFrame, question="question", context="context", answer="answer") -> DataFrame:
    """Prompt and target text."""
    return df.select(
        X.format_prompt(question, context).alias("input_text"),
        F.col(answer).alias("target_text"),
    )


def request_fault(question="question", context="context") -> Column:
    """Wording of the first rule a request breaks; null for a good one."""
    return F.when(X.is_blank(question), NO_QUESTION).when(X.is_blank(context), NO_CONTEXT)


def checked_requests(df: DataFrame, question="question", context="context") -> DataFrame:
    """All requests in one pass: ``code`` and ``detail`` are null for good ones."""
    checked = df.withColumn("detail", request_fault(question, context))
    return checked.withColumn("code", F.when(F.col("detail").isNotNull(), REJECT_CODE))


def validate_requests(
    df: DataFrame, question="question", context="context"
) -> tuple[DataFrame, DataFrame]:
    """Good requests, and rejected ones with ``code`` and ``detail``.

    Each side reads the input; :func:`checked_requests` reads it once for both.
    """
    checked = checked_requests(df, question, context)
    return checked.where("detail is null").drop("detail", "code"), checked.where("detail is not null")


def sized_payloads(df: DataFrame, payload="payload", limit: int = PAYLOAD_LIMIT) -> DataFrame:
    """All payloads in one pass, with ``encoded_length`` and whether they are ``accepted``."""
    sized = df.withColumn("encoded_length", X.encoded_length(payload))
    return sized.withColumn("accepted", F.coalesce(F.col("encoded_length") <= limit, F.lit(True)))


def payload_guard(
    df: DataFrame, payload="payload", limit: int = PAYLOAD_LIMIT
) -> tuple[DataFrame, DataFrame]:
    """Payloads within the limit, and those over it, with ``encoded_length``.

    Each side reads the input; :func:`sized_payloads` reads it once for both.
    """
    sized = sized_payloads(df, payload, limit)
    return sized.where("accepted").drop("accepted"), sized.where("not accepted").drop("accepted")


def concat_tables(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames, columns matched by name, gaps filled with null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _split_sizes(test: float, val_share: float) -> tuple[Column, Column]:
    """Positions where validation and test begin, over ``total``.

    Held-out rows are rounded up, and so is the test part of them.
    """
    held = F.ceil(F.col("total") * F.lit(test))
    tested = F.ceil(held * F.lit(val_share))
    return F.col("total") - held, F.col("total") - tested


def _seeded(df: DataFrame, key: str, seed: int) -> tuple[DataFrame, Column]:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    hashed = df.withColumn("_digest", digest)
    digits = max(2, math.ceil(math.log(max(1, df.count()) / PREFIX_ROWS, 16)))
    return hashed, F.conv(F.substring("_digest", 1, min(digits, 15)), 16, 10).cast("long")


def split_rows(
    df: DataFrame,
    key: str,
    test: float = 0.2,
    val_share: float = 0.5,
    seed: int = 42,
) -> DataFrame:
    """Add ``split`` (train, val, test) with exact sizes, in a seeded order.

    Rows are ordered by a seeded hash of the unique ``key``. The counts per hash
    prefix and a ranking inside the prefixes that a cut falls into give the exact hash
    at which each split begins; every row is then compared with those two where it is
    read, with no shuffle. Membership does not depend on partitioning or file order. A key
    that repeats where a split begins is an error, as no cut would give exact sizes.
    """
    hashed, bucket = _seeded(df, key, seed)
    val_from, test_from = _split_sizes(test, val_share)
    begins = keys_at(hashed, bucket, ["_digest", key], {"val": val_from, "test": test_from})
    place = F.struct("_digest", key)
    split = F.when(place >= begins["test"], "test").when(place >= begins["val"], "val")
    return hashed.withColumn("split", split.otherwise("train")).drop("_digest")


def raw_holdout(
    df: DataFrame,
    key: str,
    order: Sequence[str] | None = None,
    mode: str = "split",
    test: float = 0.2,
    val_share: float = 0.5,
    seed: int = 42,
) -> DataFrame:
    """Text rows kept for scoring.

    ``split`` returns the rows of the test split. ``tail`` returns as many rows from
    the end of the table in the order of ``order``: they overlap the training rows,
    and the mode exists only to reproduce scores computed that way.
    """
    if mode == "split":
        hashed, bucket = _seeded(df, key, seed)
        _, test_from = _split_sizes(test, val_share)
        rows = rank_slice(hashed, bucket, ["_digest", key], test_from, F.col("total"))
        return rows.drop("_digest")
    if mode == "tail":
        held = F.ceil(F.col("total") * F.lit(test))
        return tail_where(df, F.ceil(held * F.lit(val_share)), order or [key])
    raise ValueError(f"unknown mode: {mode}")


def leak_audit(train: DataFrame, held: DataFrame, on: Sequence[str] | Mapping[str, Column]) -> DataFrame:
    """One row: held-out rows, how many of them also stand in the training rows, their share.

    ``on`` names columns, or gives expressions by name that both sides are compared by, such
    as a normalized text. Only these reach the shuffle; nulls equal nulls.
    """
    columns = on if isinstance(on, Mapping) else {c: F.col(c) for c in on}
    key = F.xxhash64(*columns.values()), F.struct(*[c.alias(n) for n, c in columns.items()])
    left = held.select(key[0].alias("_hash"), key[1].alias("_key"))
    right = train.select(key[0].alias("_hash"), key[1].alias("_other")).distinct()
    met = left.join(right, (left["_hash"] == right["_hash"]) & F.col("_key").eqNullSafe(F.col("_other")), "left")
    return met.agg(
        F.count(F.lit(1)).alias("held"),
        F.count("_other").alias("leaked"),
        F.avg(F.col("_other").isNotNull().cast("int")).alias("share"),
    )


def split_counts(df: DataFrame, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count("*").alias("rows"))


def code_points(texts: Sequence[str]) -> list[list[int]]:
    """Stand-in encoder: one id per character. A model's tokenizer goes in its place."""
    return [[ord(c) for c in t] for t in texts]


def encoder_udf(load: Callable[[], Callable], length: int):
    """Arrow UDF from ``load() -> encode(list[str]) -> list[list[int]]``.

    ``load`` runs once per Python worker task. The encoder sees whole texts, ``ENCODED_ROWS`` at
    most in one call; its ids are cut to ``length`` before the next call.
    """

    @arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = load()
        for texts in batches:
            parts = []
            for start in range(0, len(texts), ENCODED_ROWS):
                given = ["None" if t is None else t for t in texts.slice(start, ENCODED_ROWS).to_pylist()]
                parts.append(pa.array([list(i[:length]) for i in encoder(given)], pa.list_(pa.int32())))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return encode


def pad_truncate(ids, length: int | Column, pad: int = 0) -> Column:
    """Cut to ``length`` and pad on the right to ``length``."""
    a = F.col(ids) if isinstance(ids, str) else ids
    n = F.lit(length) if isinstance(length, int) else length
    missing = F.greatest(F.lit(0), n - F.size(a))
    return F.concat(F.slice(a, F.lit(1), n), F.array_repeat(F.lit(pad), missing))


def attention_mask(ids, length: int | Column) -> Column:
    """1 for kept ids, 0 for padding."""
    return pad_truncate(F.transform(ids, lambda _: F.lit(1)), length, 0)


def encode_text(
    df: DataFrame,
    load: Callable[[], Callable],
    source: str = "input_text",
    target: str = "target_text",
    source_length: int = 512,
    target_length: int = 128,
    pad: int = 0,
) -> DataFrame:
    """Replace the two text columns by ``input_ids``, ``attention_mask``, ``labels``.

    Labels are padded with the pad id here; batching pads them with -100.
    """
    ids = df.withColumn("_source", encoder_udf(load, source_length)(source)).withColumn(
        "_target", encoder_udf(load, target_length)(target)
    )
    return ids.select(
        *[c for c in df.columns if c not in (source, target)],
        pad_truncate("_source", source_length, pad).alias("input_ids"),
        attention_mask("_source", source_length).alias("attention_mask"),
        pad_truncate("_target", target_length, pad).alias("labels"),
    )


def collate_batches(
    df: DataFrame,
    keys: Sequence[str],
    pads: Mapping[str, int],
    size: int = 16,
) -> DataFrame:
    """Number rows into batches of ``size`` and pad arrays to the longest of each batch.

    ``pads`` maps array columns to their padding value, -100 for labels.
    """
    placed = aligned_ordinal(df, keys, size, "_ord").withColumn(
        "batch", F.floor(F.col("_ord") / size).cast("long")
    )
    batch = Window.partitionBy("_bucket", "batch")  # at most ``size`` rows
    widths = {f"_{c}": F.max(F.size(c)).over(batch) for c in pads}
    padded = {c: pad_truncate(c, F.col(f"_{c}"), pad) for c, pad in pads.items()}
    return placed.withColumns(widths).withColumns(padded).select("batch", *df.columns)
