"""Pool of warm resources: state, rollups, matching, reconciliation, expiry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusflow.functions import state as S
from corpusflow.operators.ordinal import cut_points, group_ordinal, in_buckets, same_columns, with_bucket

# Fixed value: seconds an unused resource is kept.
POOL_TTL = 600

# Transitions, the status each leaves, and which ones count as use.
STATUS_AFTER = {"created": "busy", "assigned": "busy", "succeeded": "idle", "failed": "idle"}
TOUCHING = ("created", "assigned", "succeeded")


def status_after(event: str | Column) -> Column:
    """Status a transition leaves; null for anything that is not a transition."""
    e = F.col(event) if isinstance(event, str) else event
    out = F.lit(None).cast("string")
    for name, status in STATUS_AFTER.items():
        out = F.when(e == name, status).otherwise(out)
    return out


def latest_state(log: DataFrame, key="pod_name", event="event", ts="ts", tie="seq") -> DataFrame:
    """Status, last use and registration per resource from its transitions.

    ``created`` is when the resource was registered last, null if that is not in the log.
    A failure makes a resource idle without counting as use. The fold is a pair of
    ordered maxima, so it is combined before the shuffle however hot a key is.
    """
    moves = log.where(F.col(event).isin(*STATUS_AFTER))
    return moves.groupBy(key).agg(
        F.max_by(status_after(event), F.struct(ts, tie)).alias("status"),
        F.max(F.when(F.col(event).isin(*TOUCHING), F.col(ts))).alias("last_used"),
        F.max(F.when(F.col(event) == "created", F.col(ts))).alias("created"),
    )


def pool_resources(registry: DataFrame, state: DataFrame, key="pod_name", status="status") -> DataFrame:
    """One row per registered resource: what the registry holds, with its latest state.

    A column of both comes from ``state``; a resource without transitions has nulls there.
    """
    known = registry.drop(*[c for c in state.columns if c != key])
    return known.join(state, key, "left")


def pool_status(state: DataFrame, status="status") -> DataFrame:
    """One row: total, idle and busy resources."""
    return state.agg(
        F.count("*").alias("total_pods"),
        F.count_if(F.col(status) == "idle").alias("idle_pods"),
        F.count_if(F.col(status) == "busy").alias("busy_pods"),
    )


def pool_stats(state: DataFrame, status="status", fingerprint="config_hash") -> DataFrame:
    """As :func:`pool_status`, with the number of different configs."""
    return state.agg(
        F.count("*").alias("total_pods"),
        F.count_if(F.col(status) == "idle").alias("idle_pods"),
        F.count_if(F.col(status) == "busy").alias("busy_pods"),
        F.count_distinct(fingerprint).alias("config_count"),
    )


# Registers of a sketch as a power of two: a relative standard error of 1.04 / sqrt(2^14), 0.8 %.
SKETCH_BITS = 14


def pool_sketches(state: DataFrame, by, status="status", fingerprint="config_hash") -> DataFrame:
    """Rollup for large sets: per value of ``by`` the counts and a sketch of the configs.

    Sketches of a fixed size merge, so parts of a pool, or hours, are rolled up without their rows.
    """
    return state.groupBy(by).agg(
        F.count("*").alias("total_pods"),
        F.count_if(F.col(status) == "idle").alias("idle_pods"),
        F.count_if(F.col(status) == "busy").alias("busy_pods"),
        F.hll_sketch_agg(fingerprint, F.lit(SKETCH_BITS)).alias("configs"),
    )


def merge_sketches(parts: DataFrame, *by) -> DataFrame:
    """One row per value of ``by`` from the parts of :func:`pool_sketches`, with ``config_count`` estimated.

    The estimate of merged sketches may differ from that of one sketch of all rows, within the error.
    """
    return parts.groupBy(*by).agg(
        F.coalesce(F.sum("total_pods"), F.lit(0)).alias("total_pods"),
        F.coalesce(F.sum("idle_pods"), F.lit(0)).alias("idle_pods"),
        F.coalesce(F.sum("busy_pods"), F.lit(0)).alias("busy_pods"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("configs")), F.lit(0)).alias("config_count"),
    )


def pool_configs(state: DataFrame, fingerprint="config_hash") -> DataFrame:
    """The set of configs in the pool, one per row: it can outgrow a single value."""
    return state.select(fingerprint).distinct()


def expire_idle(state: DataFrame, as_of, ttl: int = POOL_TTL) -> DataFrame:
    """Idle resources unused for strictly longer than ``ttl`` seconds at ``as_of``."""
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return state.withColumn("idle_seconds", S.idle_seconds(now, "last_used")).where(
        (F.col("status") == "idle")
        & (S.micros(now) - S.micros("last_used") > ttl * 1_000_000)
    )


def idle_expiries(
    log: DataFrame,
    until,
    key="pod_name",
    event="event",
    ts="ts",
    tie="seq",
    ttl: int = POOL_TTL,
    buckets: int | None = None,
) -> DataFrame:
    """Each use after which a resource stayed idle strictly longer than ``ttl`` seconds.

    Looks at the whole log up to ``until`` rather than at its last state: a resource
    is idle from a success or failure to its next use. Gives ``last_used`` and
    ``expired_at``, one row per use. A log may belong to one resource for any part: it
    is cut into buckets by (resource, time), and the use before and after each cut is
    carried over, at most two rows per cut.
    """
    order = [key, ts, tie]
    moves = log.where(F.col(event).isin(*STATUS_AFTER)).select(*order, event)
    cuts = cut_points(moves, order, buckets)
    used = F.when(F.col(event).isin(*TOUCHING), S.micros(ts))
    base = in_buckets(with_bucket(moves, order, cuts), cuts).withColumn("_use", used)

    part = Window.partitionBy("_bucket", key)
    before = part.orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = part.orderBy(F.desc(ts), F.desc(tie)).rowsBetween(Window.unboundedPreceding, -1)
    timed = base.withColumn("_last", F.last("_use", ignorenulls=True).over(before)).withColumn(
        "_next", F.last("_use", ignorenulls=True).over(after)
    )

    by_key = Window.partitionBy(key)
    earlier = by_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    later = by_key.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    ends = with_bucket(moves, order, cuts).withColumn("_use", used)
    carried = (
        ends.groupBy("_bucket", key)
        .agg(F.min("_use").alias("_first"), F.max("_use").alias("_final"))
        .withColumn("_was", F.max("_final").over(earlier))
        .withColumn("_will", F.min("_first").over(later))
        .where("_was is not null or _will is not null")
        .select("_bucket", key, "_was", "_will")
    )

    end = F.lit(until) if isinstance(until, int) else S.micros(F.lit(until))
    idle = (
        timed.where(status_after(event) == "idle")
        .alias("a")
        .join(F.broadcast(carried.alias("b")), same_columns("_bucket", key), "left")
        .select(
            F.col(f"a.{key}").alias(key),
            F.coalesce("_last", "_was").alias("_used"),
            F.coalesce(F.col("_next"), F.col("_will"), end).alias("_until"),
        )
    )
    limit = ttl * 1_000_000
    expired = idle.where(F.col("_until") - F.col("_used") > limit).select(key, "_used").distinct()
    return expired.select(
        key,
        F.timestamp_micros("_used").alias("last_used"),
        F.timestamp_micros(F.col("_used") + limit).alias("expired_at"),
    )


def resource_ready(
    pool: DataFrame, observed: DataFrame, key="pod_name", phase="phase", address="ip"
) -> DataFrame:
    """Pool rows whose resource is running and reachable, with its current address."""
    live = observed.where(S.resource_ready(phase, address)).select(
        key, F.col(address).alias("pod_ip")
    )
    return pool.drop("pod_ip").join(live, key, "inner")


def match_warm(
    requests: DataFrame,
    idle: DataFrame,
    arrival: Sequence[str],
    insertion: Sequence[str],
    fingerprint: str = "config_hash",
    resource: str = "pod_name",
) -> DataFrame:
    """Give every request, in arrival order, the first unused idle resource of its config.

    A request without one has a null ``resource`` and ``warm`` false. Requests and
    resources of a config are numbered and joined on the number, which equals serving
    them one by one from a fixed idle set; resources freed meanwhile need the state
    folded first. Numbering splits a config that fills a third of the requests, and
    the join key is (config, number), so no key is hot.
    """
    asked = group_ordinal(requests, [fingerprint], arrival, "_place")
    offered = group_ordinal(
        idle.select(fingerprint, resource, *[c for c in insertion if c not in (fingerprint, resource)]),
        [fingerprint],
        insertion,
        "_place",
    ).select(fingerprint, "_place", resource)
    return (
        asked.join(offered, [fingerprint, "_place"], "left")
        .withColumn("warm", F.col(resource).isNotNull())
        .select(*requests.columns, resource, "warm")
    )


def recover_pool(observed: DataFrame, now, key="pod_name", phase="phase", address="ip") -> DataFrame:
    """Decide on observed resources when nothing is registered.

    Running and reachable ones come back as idle, used ``now``, creation kept (``now``
    when unknown); ``action`` is ``register`` for them and ``delete`` for the rest.
    """
    ready = S.resource_ready(phase, address)
    at = (now if isinstance(now, Column) else F.lit(now)).cast("timestamp")

    def kept(value):
        return F.when(ready, value)

    return observed.select(
        key,
        F.when(ready, "register").otherwise("delete").alias("action"),
        kept(F.lit("idle")).alias("status"),
        kept(F.coalesce("config_hash", F.lit("unknown"))).alias("config_hash"),
        kept(at).alias("last_used"),
        kept(F.coalesce(F.col("created").cast("timestamp"), at)).alias("created"),
        kept(F.col(address)).alias("pod_ip"),
    )


def reconcile(
    registry: DataFrame, observed: DataFrame, key="pod_name", phase="phase", address="ip"
) -> DataFrame:
    """Compare a live registry with what is observed: one ``action`` per resource.

    ``keep`` (known and ready), ``register`` (ready, unknown), ``delete`` (observed,
    not ready) and ``forget`` (registered, gone).
    """
    known = registry.select(key, F.lit(True).alias("_known"))
    seen = observed.select(
        key, S.resource_ready(phase, address).alias("_ready"), F.lit(True).alias("_seen")
    )
    action = (
        F.when(F.col("_seen").isNull(), "forget")
        .when(~F.col("_ready"), "delete")
        .when(F.col("_known").isNull(), "register")
        .otherwise("keep")
    )
    return known.join(seen, key, "full").select(key, action.alias("action"))
