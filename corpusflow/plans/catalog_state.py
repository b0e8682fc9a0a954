"""Queries: pool state, activity and the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.functions import activity as A, state as S
from corpusflow.operators import activity, pool
from corpusflow.operators.layout import spread
from corpusflow.plans.catalog_scoring import echo_question
from corpusflow.plans.inputs import (
    QUESTIONS,
    LATEST_STATE,
    OBSERVED,
    POOL,
    POOL_LOG,
    REQUESTS,
    SAMPLES,
    questions,
    observed,
    pool as pool_table,
    pool_log,
    requests,
    samples,
    sql_strip,
)
from corpusflow.plans.registry import query
from corpusflow.session import scratch_path
from corpusflow.sources.tables import read_table
from corpusflow.streaming import feeds, idle, pool as pool_streams

AS_OF = "2024-01-31 00:00:00"
# Fixed values in the SQL below: prompt, rejection, summary and marker texts, spelled out.
FAR = "2100-01-01 00:00:00"


# --- pool ------------------------------------------------------------------------


@query(f"SELECT o_orderkey, config_hash FROM {REQUESTS}")
def config_fingerprint(spark, sf):
    return requests(spark, sf).select("o_orderkey", "config_hash")


@query(f"SELECT o_orderkey, ttl IS NULL OR ttl <> 0 AS pooled FROM {REQUESTS}")
def pool_eligibility(spark, sf):
    return requests(spark, sf).select("o_orderkey", S.pool_eligible("ttl").alias("pooled"))


@query(f"SELECT * FROM {LATEST_STATE}")
def latest_state(spark, sf):
    return pool.latest_state(pool_log(spark, sf))


@query(f"""
SELECT p.pod_name, s.status, p.config_hash, s.last_used, s.created, '10.0.0.1' AS pod_ip
FROM {POOL} p LEFT JOIN {LATEST_STATE} s USING (pod_name)""")
def pool_resources(spark, sf):
    found = pool.pool_resources(pool_table(spark, sf), latest_state(spark, sf))
    return found.select("pod_name", "status", "config_hash", "last_used", "created", "pod_ip")


@query(f"""
SELECT count(*) AS total_pods, count(*) FILTER (WHERE status = 'idle') AS idle_pods,
       count(*) FILTER (WHERE status = 'busy') AS busy_pods
FROM {LATEST_STATE}""")
def pool_status(spark, sf):
    return pool.pool_status(latest_state(spark, sf))


@query(f"""
SELECT count(*) AS total_pods, count(*) FILTER (WHERE status = 'idle') AS idle_pods,
       count(*) FILTER (WHERE status = 'busy') AS busy_pods,
       count(DISTINCT config_hash) AS config_count
FROM {POOL}""")
def pool_stats(spark, sf):
    return pool.pool_stats(pool_table(spark, sf))


@query(f"""
SELECT count(*) AS total_pods, count(*) FILTER (WHERE status = 'idle') AS idle_pods,
       count(*) FILTER (WHERE status = 'busy') AS busy_pods,
       count(DISTINCT config_hash) AS config_count, true AS within, true AS one_pass_within
FROM {POOL}""")
def pool_stats_sketch(spark, sf):
    """Exact counts beside those of merged sketches: within 4 %, as is one sketch of all rows."""
    state = pool_table(spark, sf)
    parts = pool.pool_sketches(state, F.pmod(F.xxhash64("pod_name"), F.lit(24)).alias("part"))
    whole = pool.pool_sketches(state, F.lit(-1).cast("long").alias("part"))
    one = F.lit(1).alias("_one")  # each side is one row
    estimates = pool.merge_sketches(parts).select("*", one).withColumnRenamed("config_count", "_parts")
    both = pool.merge_sketches(whole).select(F.col("config_count").alias("_whole"), one)
    estimates = estimates.join(both, "_one")
    exact = pool.pool_stats(state).select("config_count", one)
    near = lambda c: F.abs(F.col(c) - F.col("config_count")) <= 0.04 * F.col("config_count")
    return estimates.join(exact, "_one").select(
        "total_pods",
        "idle_pods",
        "busy_pods",
        "config_count",
        near("_parts").alias("within"),
        near("_whole").alias("one_pass_within"),
    )


@query(f"SELECT DISTINCT config_hash FROM {POOL}")
def pool_configs(spark, sf):
    return pool.pool_configs(pool_table(spark, sf))


@query(f"""
SELECT pod_name, last_used, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_used)) / 1e6 AS idle_seconds
FROM {LATEST_STATE}
WHERE status = 'idle' AND epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_used) > 7200000000""")
def expire_idle(spark, sf):
    expired = pool.expire_idle(latest_state(spark, sf), AS_OF, 7200)
    return expired.select("pod_name", "last_used", "idle_seconds")


@query(f"""
SELECT p.pod_name, p.status, o.ip AS pod_ip FROM {POOL} p JOIN {OBSERVED} o USING (pod_name)
WHERE o.phase = 'Running' AND o.ip <> ''""")
def resource_ready(spark, sf):
    ready = pool.resource_ready(pool_table(spark, sf), observed(spark, sf))
    return ready.select("pod_name", "status", "pod_ip")


@query(f"""
SELECT r.o_orderkey, r.config_hash, p.pod_name, p.pod_name IS NOT NULL AS warm
FROM (SELECT *, row_number() OVER (PARTITION BY config_hash ORDER BY o_orderdate, o_orderkey) AS place
      FROM {REQUESTS} WHERE ttl IS NULL OR ttl <> 0) r
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY config_hash ORDER BY inserted) AS place
           FROM {POOL} WHERE status = 'idle') p
  ON p.config_hash = r.config_hash AND p.place = r.place""")
def match_warm(spark, sf):
    asked = requests(spark, sf).where(S.pool_eligible("ttl"))
    idle_set = pool_table(spark, sf).where("status = 'idle'")
    matched = pool.match_warm(asked, idle_set, ["o_orderdate", "o_orderkey"], ["inserted"])
    return matched.select("o_orderkey", "config_hash", "pod_name", "warm")


_EXPIRIES = f"""
WITH folded AS (
  SELECT pod_name, ts, event, lead(ts) OVER w AS next_ts,
         max(CASE WHEN event <> 'failed' THEN ts END) OVER w AS last_used
  FROM {POOL_LOG} WINDOW w AS (PARTITION BY pod_name ORDER BY ts, seq))
SELECT DISTINCT pod_name, last_used, last_used + INTERVAL 7200 SECOND AS expired_at
FROM folded
WHERE event IN ('succeeded', 'failed') AND last_used IS NOT NULL
  AND epoch_us(coalesce(next_ts, TIMESTAMP '{FAR}')) - epoch_us(last_used) > 7200000000"""


@query(_EXPIRIES)
def idle_expiries(spark, sf):
    return pool.idle_expiries(pool_log(spark, sf), FAR, ttl=7200)


_READY = "(phase = 'Running' AND coalesce(ip, '') <> '')"


@query(f"""
SELECT pod_name, CASE WHEN {_READY} THEN 'register' ELSE 'delete' END AS action,
       CASE WHEN {_READY} THEN 'idle' END AS status,
       CASE WHEN {_READY} THEN coalesce(config_hash, 'unknown') END AS config_hash,
       CASE WHEN {_READY} THEN TIMESTAMP '{AS_OF}' END AS last_used,
       CASE WHEN {_READY} THEN coalesce(created, TIMESTAMP '{AS_OF}') END AS created,
       CASE WHEN {_READY} THEN ip END AS pod_ip
FROM {OBSERVED}""")
def recover_pool(spark, sf):
    return pool.recover_pool(observed(spark, sf), AS_OF)


@query(f"""
SELECT coalesce(p.pod_name, o.pod_name) AS pod_name,
       CASE WHEN o.pod_name IS NULL THEN 'forget' WHEN NOT {_READY} THEN 'delete'
            WHEN p.pod_name IS NULL THEN 'register' ELSE 'keep' END AS action
FROM {POOL} p FULL JOIN {OBSERVED} o ON p.pod_name = o.pod_name""")
def reconcile(spark, sf):
    return pool.reconcile(pool_table(spark, sf), observed(spark, sf))


# --- activity ----------------------------------------------------------------------


def _responses(spark, sf):
    """Kernel and terminal responses per event; error events carry broken JSON."""
    state = F.when(F.col("event_type") == "click", "busy").otherwise("idle")
    kernels = F.concat(
        F.lit('[{"id":"a","execution_state":"idle"},{"id":"b","execution_state":"'),
        state,
        F.when(F.col("event_type") == "error", '"').otherwise('"}]'),
    )
    terminals = F.when(F.col("event_type") == "purchase", '[{"name":"1"}]').otherwise("[]")
    return read_table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("value") > 20, 403).otherwise(200).alias("kernels_status"),
        kernels.alias("kernels"),
        F.when(F.col("value") > 10, 200).alias("terminals_status"),
        terminals.alias("terminals"),
        F.when(F.col("event_type") == "view", F.get_json_object("props", "$.k").cast("int") % 3)
        .alias("sessions"),
    )


_ACTIVE = """(event_type = 'click' AND value <= 20) OR (event_type = 'purchase' AND value > 10)
       OR (event_type = 'view' AND CAST(json_extract(props, '$.k') AS INT) % 3 > 0)"""


@query(f"SELECT event_id, {_ACTIVE} AS active FROM events")
def activity_predicate(spark, sf):
    return _responses(spark, sf).select("event_id", activity.activity_predicate().alias("active"))


@query("SELECT event_id, event_type = 'click' AS busy FROM events")
def any_busy(spark, sf):
    return _responses(spark, sf).select("event_id", A.any_busy("kernels").alias("busy"))


def _tcp_lines(spark, sf):
    """TCP table lines from line items: supplier is the entity, return flag the sample."""
    port = (
        F.when(F.col("l_partkey") % 3 == 0, "0016")
        .when(F.col("l_partkey") % 3 == 1, "1f90")
        .otherwise("0050")
    )
    state = F.when(F.col("l_linestatus") == "O", "01").otherwise("0A")
    address = F.when(F.col("l_tax") == 0, "0100007F").otherwise(
        F.concat(F.lit("0100007F:"), port)
    )
    return spread(read_table(spark, sf, "lineitem")).select(
        "l_suppkey",
        "l_returnflag",
        F.concat(
            F.lit("  "), "l_linenumber", F.lit(":  "), address, F.lit("\t00000000:0000 "), state
        ).alias("line"),
        (F.col("l_linenumber") - 1).alias("line_number"),
    )


@query("""
SELECT CASE WHEN l_tax <> 0 THEN CASE l_partkey % 3 WHEN 0 THEN '0016' WHEN 1 THEN '1F90' ELSE '0050' END END AS port,
       CASE WHEN l_tax <> 0 THEN CASE l_partkey % 3 WHEN 0 THEN 22::BIGINT WHEN 1 THEN 8080 ELSE 80 END END AS port_number,
       CASE WHEN l_tax <> 0 THEN CASE WHEN l_linestatus = 'O' THEN '01' ELSE '0A' END END AS state,
       count(*) AS lines
FROM lineitem GROUP BY 1, 2, 3""")
def tcp_fields(spark, sf):
    fields = _tcp_lines(spark, sf).select(A.tcp_fields("line").alias("f")).select("f.*")
    return fields.groupBy("port", "port_number", "state").agg(F.count("*").alias("lines"))


@query("""
SELECT l_suppkey, l_returnflag, count(*) FILTER (
         WHERE l_linenumber > 1 AND l_tax <> 0 AND l_partkey % 3 = 0 AND l_linestatus = 'O') AS sessions
FROM lineitem GROUP BY l_suppkey, l_returnflag""")
def count_sessions(spark, sf):
    return activity.count_sessions(_tcp_lines(spark, sf), ["l_suppkey", "l_returnflag"])


@query(f"""
SELECT event_id, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 1e6 AS idle_seconds FROM events""")
def idle_seconds(spark, sf):
    return read_table(spark, sf, "events").select(
        "event_id", S.idle_seconds(F.lit("2024-01-31T00:00:00"), "ts").alias("idle_seconds")
    )


_EPISODES = f"""
WITH runs AS (
  SELECT *, sum(CAST(active AS INT)) OVER (PARTITION BY entity ORDER BY ts, seq) AS episode
  FROM {SAMPLES}),
timed AS (
  SELECT *, min(CASE WHEN NOT active THEN ts END) OVER (PARTITION BY entity, episode) AS started
  FROM runs)
SELECT entity, ts, seq, active, CASE WHEN NOT active THEN started END AS idle_since,
       CASE WHEN NOT active THEN (epoch_us(ts) - epoch_us(started)) / 1e6 END AS idle_seconds,
       NOT active AND epoch_us(ts) - epoch_us(started) >= 86400000000 AS alert
FROM timed"""


@query(_EPISODES)
def idle_episodes(spark, sf):
    return activity.idle_episodes(samples(spark, sf), threshold=86400)


# --- streams -------------------------------------------------------------------------


def _feed(spark, df, label, files=None):
    """Store rows as files and read them back as a stream."""
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return feeds.read_stream(spark, path, df.schema, files_per_trigger=files)


def _clock(spark, sf):
    """One instant behind all events: the present of a stream whose rows have ended."""
    last = read_table(spark, sf, "events").agg(F.max("ts").cast("timestamp").alias("ts"))
    far = F.greatest(F.col("ts"), F.lit(FAR).cast("timestamp")).alias("ts")
    return _feed(spark, last.select(far), "clock")


@query("SELECT event_id, ts, user_id, event_type, value FROM events")
def read_stream(spark, sf):
    """Take the events as a feed and store them through a stream."""
    schema = read_table(spark, sf, "events").schema
    feed = feeds.read_stream(spark, sf, schema, glob="events.parquet")
    stored = feeds.run_available(feed, scratch_path(spark, "feed"))
    return stored.select("event_id", "ts", "user_id", "event_type", "value")


@query(f"SELECT event_id, {_ACTIVE} AS active FROM events")
def activity_stream(spark, sf):
    feed = _feed(spark, _responses(spark, sf), "responses")
    out = feeds.activity_stream(feed).select("event_id", "active")
    return feeds.run_available(out, scratch_path(spark, "activity"))


@query(f"""
SELECT conv_id, turn, {sql_strip('question')} AS sql,
       'translate English to SQL: ' || question || ' </s> Tables: ' || context AS prompt
FROM {QUESTIONS} WHERE context IS NOT NULL""")
def answer_stream(spark, sf):
    feed = _feed(spark, questions(spark, sf), "requests")
    out = feeds.answer_stream(feed, echo_question).select("conv_id", "turn", "sql", "prompt")
    return feeds.run_available(out, scratch_path(spark, "answers"))


@query(_EPISODES)
def idle_alerts_stream(spark, sf):
    feed = _feed(spark, samples(spark, sf), "samples")
    found = idle.idle_alerts_stream(feed, threshold=86400, clock=_clock(spark, sf))
    return feeds.run_available(found, scratch_path(spark, "alerts"))


@query(f"SELECT * FROM {LATEST_STATE}")
def pool_state_stream(spark, sf):
    feed = _feed(spark, pool_log(spark, sf), "transitions")
    state = pool_streams.pool_state_stream(feed)
    return pool_streams.keep_state(state, scratch_path(spark, "state"))


@query(_EXPIRIES)
def expire_idle_stream(spark, sf):
    feed = _feed(spark, pool_log(spark, sf), "transitions")
    found = pool_streams.expire_idle_stream(feed, ttl=7200, clock=_clock(spark, sf))
    return feeds.run_available(found, scratch_path(spark, "expired"))
