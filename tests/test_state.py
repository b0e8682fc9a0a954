import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import pool as P, runs as R

T0 = datetime(2024, 1, 1)


def test_latest_state_equals_a_loop(spark):
    rng = random.Random(2)
    log, want = [], {}
    for i in range(4000):
        pod = "hot" if rng.random() < 0.5 else f"p{rng.randrange(40)}"
        event = rng.choice(["created", "assigned", "succeeded", "failed", "other"])
        at = T0 + timedelta(seconds=rng.randrange(9000))
        log.append((pod, event, at, i))
    for pod, event, at, i in sorted(log, key=lambda r: (r[2], r[3])):
        if event == "other":
            continue
        old = want.get(pod, (None, None, None))
        status = "busy" if event in ("created", "assigned") else "idle"
        created = at if event == "created" else old[2]
        want[pod] = (status, old[1] if event == "failed" else at, created)
    df = spark.createDataFrame(log, "pod_name string, event string, ts timestamp, seq long")
    got = {r["pod_name"]: tuple(r)[1:] for r in P.latest_state(df.repartition(5)).collect()}
    assert got == want


def test_expiry_is_strict_and_spares_busy(spark):
    used = [T0, T0 - timedelta(microseconds=1), T0 - timedelta(days=9), None]
    rows = [("at", "idle", used[0]), ("over", "idle", used[1]), ("busy", "busy", used[2]), ("none", "idle", used[3])]
    df = spark.createDataFrame(rows, "pod_name string, status string, last_used timestamp")
    got = P.expire_idle(df, T0 + timedelta(seconds=600)).collect()
    assert [(r["pod_name"], r["idle_seconds"]) for r in got] == [("over", 600.000001)]


@pytest.mark.parametrize("parts", [1, 6])
def test_match_warm_equals_serving_in_turn(spark, parts):
    rng = random.Random(4)
    asked = [(i, "hot" if rng.random() < 0.6 else f"h{rng.randrange(9)}") for i in range(3000)]
    idle = [(f"pod{i}", i, rng.choice(["hot", "h1", "h2", "h99"])) for i in range(1500)]
    pool, want = list(idle), {}
    for i, h in asked:
        hit = next((p for p in pool if p[2] == h), None)
        want[i] = hit[0] if hit else None
        if hit:
            pool.remove(hit)
    requests = spark.createDataFrame(asked, "i int, config_hash string").repartition(parts)
    resources = spark.createDataFrame(idle, "pod_name string, n int, config_hash string").repartition(parts)
    got = P.match_warm(requests, resources, ["i"], ["n"]).collect()
    assert {r["i"]: r["pod_name"] for r in got} == want
    assert all(r["warm"] == (r["pod_name"] is not None) for r in got) and len(got) == 3000


OBSERVED = [
    ("a", "Running", "1.1.1.1", "h", T0),
    ("b", "Running", "", "h", T0),
    ("c", "Pending", "1.1.1.2", "h", T0),
    ("d", "Failed", None, "h", T0),
    ("e", "Running", "1.1.1.3", None, None),
]
OBSERVED_SCHEMA = "pod_name string, phase string, ip string, config_hash string, created timestamp"


def test_recover_pool(spark):
    now = T0 + timedelta(hours=1)
    got = P.recover_pool(spark.createDataFrame(OBSERVED, OBSERVED_SCHEMA), now).collect()
    assert [tuple(r) for r in got] == [
        ("a", "register", "idle", "h", now, T0, "1.1.1.1"),
        ("b", "delete", None, None, None, None, None),
        ("c", "delete", None, None, None, None, None),
        ("d", "delete", None, None, None, None, None),
        ("e", "register", "idle", "unknown", now, now, "1.1.1.3"),
    ]


def test_reconcile_and_ready(spark):
    observed = spark.createDataFrame(OBSERVED, OBSERVED_SCHEMA)
    registry = spark.createDataFrame([("a", "0"), ("b", "0"), ("z", "0")], "pod_name string, pod_ip string")
    got = {r["pod_name"]: r["action"] for r in P.reconcile(registry, observed).collect()}
    assert got == {"a": "keep", "b": "delete", "c": "delete", "d": "delete", "e": "register", "z": "forget"}
    ready = P.resource_ready(registry, observed).collect()
    assert [tuple(r) for r in ready] == [("a", "1.1.1.1")]


def test_pool_rollups(spark):
    rows = [("a", "idle", "h"), ("b", "busy", "h"), ("c", "idle", "g")]
    df = spark.createDataFrame(rows, "pod_name string, status string, config_hash string")
    assert tuple(P.pool_status(df).first()) == (3, 2, 1)
    assert tuple(P.pool_stats(df).first()) == (3, 2, 1, 2)
    assert {r[0] for r in P.pool_configs(df).collect()} == {"g", "h"}
    assert tuple(P.pool_status(df.limit(0)).first()) == (0, 0, 0)


def test_checkpoints(spark):
    rows = [
        ("r", "checkpoint-200", True, 0.5),
        ("r", "checkpoint-1000", True, 0.5),
        ("r", "checkpoint-3000", False, 0.1),
        ("r", "checkpoint-best", True, 0.9),
        ("r", "other-5000", True, 0.9),
        ("s", "checkpoint-7", True, None),
    ]
    df = spark.createDataFrame(rows, "run_id string, name string, is_dir boolean, eval_loss double")
    latest = {r["run_id"]: (r["latest"], r["step"]) for r in R.latest_checkpoint(df).collect()}
    assert latest == {"r": ("checkpoint-1000", 1000), "s": ("checkpoint-7", 7)}
    _, rejected = R.checkpoint_listing(df)
    assert [r["name"] for r in rejected.collect()] == ["checkpoint-best"]
    best = {r["run_id"]: r["best"] for r in R.best_checkpoint(df.where("is_dir")).collect()}
    assert best == {"r": "checkpoint-200"}


def test_next_version(spark):
    history = spark.createDataFrame([("m", 1), ("m", 4)], "name string, version int")
    names = spark.createDataFrame([("m",), ("n",), ("n",)], "name string")
    got = {r["name"]: tuple(r)[1:] for r in R.next_version(history, names).collect()}
    assert got == {"m": (4, 5, "models:/m/5"), "n": (None, 1, "models:/n/1")}


def test_sketches_of_parts_and_of_the_whole_are_near(spark):
    """One config owns most rows, some have none; parts merge to what one pass tells."""
    rows = [(f"p{k}", "idle" if k % 3 else "busy", "hot" if k % 2 else f"c{k}" if k % 50 else None) for k in range(20_000)]
    state = spark.createDataFrame(rows, "pod_name string, status string, config_hash string")
    parts = P.pool_sketches(state, F.pmod(F.hash("pod_name"), F.lit(7)).alias("part"))
    merged = P.merge_sketches(parts).first()
    whole = P.merge_sketches(P.pool_sketches(state, F.lit(-1).alias("part"))).first()
    exact = P.pool_stats(state).first()
    for found in (merged, whole):
        assert found[:3] == exact[:3] and abs(found.config_count - exact.config_count) <= 0.04 * exact.config_count
    none = P.merge_sketches(P.pool_sketches(state.where("false"), F.lit(0).alias("part"))).first()
    assert tuple(none) == (0, 0, 0, 0)
