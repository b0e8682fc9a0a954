"""Pool state and expiry as streams."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, functions as F, types as T

from corpusflow.functions.state import micros
from corpusflow.operators.pool import POOL_TTL, STATUS_AFTER, TOUCHING, latest_state
from corpusflow.streaming.stateful import TICK, InOrder, held_seq, in_order, with_clock


def pool_state_stream(log: DataFrame, key="pod_name", event="event", ts="ts", tie="seq") -> DataFrame:
    """Running state per resource, for update or complete mode.

    The batch fold as a streaming aggregation: ordered maxima do not depend on the
    order of arrival, and each trigger combines its rows before the shuffle.
    """
    return latest_state(log, key, event, ts, tie)


def keep_state(state: DataFrame, root: str, key: str = "pod_name") -> DataFrame:
    """Run an updating stream on what is there; return the last row of every key.

    Each trigger writes its changed rows to a folder of its own, replaced as a whole
    if the trigger is repeated, so a restart leaves no row twice.
    """
    spark = state.sparkSession
    out = posixpath.join(root, "rows")

    def store(changed: DataFrame, epoch: int) -> None:
        changed.write.mode("overwrite").parquet(posixpath.join(out, f"epoch={epoch}"))

    query = (
        state.writeStream.outputMode("update")
        .option("checkpointLocation", posixpath.join(root, "checkpoint"))
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )
    query.awaitTermination()
    values = [c for c in state.columns if c != key]
    last = F.max_by(F.struct(*values), "epoch").alias("_last")
    return spark.read.parquet(out).groupBy(key).agg(last).select(key, "_last.*")


MOVE = "us long, seq long, event string"
STATE = "status string, used_us long, told boolean"
OUT = "pod_name string, used_us long"


def expiry_fold(ttl: int):
    """State of one resource; tells each use once, when it is idle for longer than ``ttl`` after it."""
    limit = ttl * 1_000_000

    def fold(carried, rows, mark):
        status, used, told = carried
        out = []

        def expire(now):
            nonlocal told
            if status == "idle" and used is not None and not told and now - used > limit:
                out.append((used,))
                told = True

        for us, _, event in rows:
            expire(us)
            status = STATUS_AFTER[event]
            if event in TOUCHING:
                used, told = us, False
        expire(mark)
        waits = status == "idle" and used is not None and not told
        return out, (status, used, told), used + limit if waits else None

    return fold


def expire_idle_stream(
    log: DataFrame, delay_seconds: int = 0, ttl: int = POOL_TTL, clock: DataFrame | None = None
) -> DataFrame:
    """One row whenever a resource stays idle strictly longer than ``ttl`` seconds.

    The rule of :func:`idle_expiries` on transitions (``pod_name``, ``event``, ``ts``,
    ``seq``), with the watermark as the present. A timer at the end of the TTL expires a
    resource that gets no more transitions; ``clock`` (``ts``) moves the present on where no
    transitions come at all.
    """
    moves = log.where(F.col("event").isin(*STATUS_AFTER)).select(
        F.col("pod_name").cast("string"), "event", F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long")
    )
    timed = with_clock(moves, "ts", clock).withColumn("us", micros("ts"))
    processor = InOrder("pod_name", MOVE, STATE, T.StructType.fromDDL(OUT), expiry_fold(ttl))
    found = in_order(timed.select("pod_name", "ts", "us", held_seq(), "event", TICK), "ts", delay_seconds, processor)
    return found.select(
        "pod_name",
        F.timestamp_micros("used_us").alias("last_used"),
        F.timestamp_micros(F.col("used_us") + ttl * 1_000_000).alias("expired_at"),
    )
