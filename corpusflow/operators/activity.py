"""Activity of entities and how long they have been idle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusflow.functions import activity as A, state as S
from corpusflow.operators.ordinal import cut_points, in_buckets, same_columns, with_bucket

# Fixed value: seconds without activity before an alert.
IDLE_THRESHOLD = 1800


def activity_predicate(
    kernels_status="kernels_status",
    kernels="kernels",
    terminals_status="terminals_status",
    terminals="terminals",
    sessions="sessions",
) -> Column:
    """Any busy kernel, open terminal or session; a failed response counts as none."""
    return (
        (A.responded(kernels_status) & A.any_busy(kernels))
        | (A.responded(terminals_status) & A.any_item(terminals))
        | F.coalesce(F.col(sessions) > 0, F.lit(False))
    )


def count_sessions(
    lines: DataFrame,
    group: Sequence[str],
    line="line",
    line_number: str | None = "line_number",
    port: str = A.SSH_PORT,
    state: str = A.ESTABLISHED,
) -> DataFrame:
    """Established connections on ``port`` per group, 0 included; line 0 is the header."""
    body = F.col(line_number) > 0 if line_number else F.lit(True)
    return lines.groupBy(*group).agg(
        F.count_if(body & A.is_session(line, port, state)).alias("sessions")
    )


def idle_episodes(
    samples: DataFrame,
    key="entity",
    ts="ts",
    active="active",
    tie="seq",
    threshold: int = IDLE_THRESHOLD,
    buckets: int | None = None,
) -> DataFrame:
    """Add ``idle_since``, ``idle_seconds`` and ``alert`` to every sample.

    The first inactive sample after activity starts the timer; each later inactive
    one whose elapsed time reaches ``threshold`` seconds raises an alert, until
    activity clears the timer. ``(ts, tie)`` must be unique per entity.

    An entity may own any share of the samples: its history is cut into buckets by
    (entity, time), timed within each, and the timer is carried over the cuts. Only
    carried timers are broadcast, at most one per cut point.
    """
    order = [key, ts, tie]
    at = F.struct(S.micros(ts).alias("us"), F.col(tie).alias("tie"))
    cuts = cut_points(samples, order, buckets)
    base = (
        in_buckets(with_bucket(samples, order, cuts), cuts)
        .withColumn("_on", F.coalesce(F.col(active), F.lit(False)))
        .withColumn("_at", at)
    )

    part = Window.partitionBy("_bucket", key).orderBy(ts, tie)
    upto = part.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = ~F.col("_on") & F.coalesce(F.lag("_on").over(part), F.lit(True))
    timed = base.withColumn("_start", F.when(starts, F.col("_at"))).withColumns(
        {
            "_since": F.last("_start", ignorenulls=True).over(upto),
            "_seen": F.max("_on").over(upto),
        }
    )

    # One row per entity and bucket: was there activity, and the timer at its end.
    ends = timed.groupBy("_bucket", key).agg(
        F.max("_on").alias("_any"),
        F.max_by(F.when(~F.col("_on"), F.col("_since")), F.col("_at")).alias("_end"),
    )
    by_bucket = Window.partitionBy(key).orderBy("_bucket")
    run = by_bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_run = (
        Window.partitionBy(key, "_run")
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    carried = (
        ends.withColumn("_run", F.sum(F.col("_any").cast("int")).over(run))
        .withColumn("_timer", F.min("_end").over(in_run))
        .select("_bucket", key, F.lag("_timer").over(by_bucket).alias("_carry"))
        .where("_carry is not null")
    )

    joined = timed.alias("a").join(F.broadcast(carried.alias("b")), same_columns("_bucket", key), "left")
    since = F.when(
        ~F.col("_on"),
        F.when(F.col("_seen"), F.col("_since")).otherwise(F.coalesce("_carry", "_since")),
    )
    done = joined.select(*[F.col(f"a.{c}") for c in [*samples.columns, "_at"]], since.alias("_since"))
    elapsed = F.col("_at.us") - F.col("_since.us")
    return done.select(
        *samples.columns,
        F.timestamp_micros("_since.us").alias("idle_since"),
        (elapsed / F.lit(1_000_000.0)).alias("idle_seconds"),
        F.coalesce(
            (elapsed >= threshold * 1_000_000) & (F.col("_at") != F.col("_since")), F.lit(False)
        ).alias("alert"),
    )
