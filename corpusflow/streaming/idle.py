"""Idle alerts per entity as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from corpusflow.functions.state import micros
from corpusflow.operators.activity import IDLE_THRESHOLD
from corpusflow.streaming.stateful import NO_SEQ, TICK, InOrder, held_seq, in_order, with_clock

SAMPLE = "us long, seq long, active boolean"
OUT = "entity string, us long, seq long, active boolean, since_us long, alert boolean"


def idle_fold(threshold: int):
    """The timer of one entity: starts with an inactive sample, alerts once it reaches ``threshold``."""

    def fold(carried, rows, mark):
        (since,) = carried
        out = []
        for us, seq, active in rows:
            alert = False
            if active:
                since = None
            elif since is None:
                since = us
            else:
                alert = us - since >= threshold * 1_000_000
            out.append((us, seq, active, since, alert))
        return out, (since,), None

    return fold


def idle_alerts_stream(
    samples: DataFrame, delay_seconds: int = 0, threshold: int = IDLE_THRESHOLD, clock: DataFrame | None = None
) -> DataFrame:
    """Every sample with ``idle_since``, ``idle_seconds`` and ``alert``, as the batch rule has them.

    ``samples``: ``entity``, ``ts``, ``seq``, ``active``. A sample is written once the
    watermark, the latest time seen less the delay, has passed it; ``clock`` (``ts``) moves it
    on where no samples come. Samples without a time are dropped, later ones than the
    watermark too.
    """
    rows = samples.select(
        F.col("entity").cast("string"), F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long"), "active"
    )
    timed = with_clock(rows, "ts", clock).withColumn("us", micros("ts"))
    processor = InOrder("entity", SAMPLE, "since_us long", T.StructType.fromDDL(OUT), idle_fold(threshold))
    found = in_order(timed.select("entity", "ts", "us", held_seq(), "active", TICK), "ts", delay_seconds, processor)
    elapsed = (F.col("us") - F.col("since_us")) / F.lit(1_000_000.0)
    return found.select(
        "entity",
        F.timestamp_micros("us").alias("ts"),
        F.nullif("seq", F.lit(NO_SEQ)).alias("seq"),
        "active",
        F.timestamp_micros("since_us").alias("idle_since"),
        elapsed.alias("idle_seconds"),
        "alert",
    )
