import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from corpusflow.operators import activity as A, pool as P
from corpusflow.streaming import feeds, idle, pool as S

T0 = datetime(2024, 1, 1)
END = datetime(2030, 1, 1)


def write_in_turns(spark, path, rows, schema, turns):
    """One file per turn, oldest first by modification time."""
    size = -(-len(rows) // turns)
    for t in range(turns):
        part = rows[t * size : (t + 1) * size]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)


def late_order(rows, rng, spread):
    """Order of arrival: event time with up to ``spread`` seconds of disorder."""
    return sorted(rows, key=lambda r: r[2 if isinstance(r[2], datetime) else 1] + timedelta(seconds=rng.uniform(0, spread)))


SAMPLE = "entity string, ts timestamp, seq long, active boolean"
MOVES = "pod_name string, event string, ts timestamp, seq long"
EPISODE = ["entity", "ts", "seq", "active", "idle_since", "idle_seconds", "alert"]


def tick(spark, path, at):
    """A clock feed of one instant."""
    spark.createDataFrame([(at,)], "ts timestamp").coalesce(1).write.mode("append").parquet(path)
    return feeds.read_stream(spark, path, "ts timestamp")


def in_seq(df, names=EPISODE):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=lambda r: (str(r[0]), r[2]))


@pytest.mark.parametrize("turns", [1, 5])
def test_idle_stream_equals_batch(spark, tmp_path, turns):
    """One entity owns most rows, rows come out of order, and a null entity is an entity."""
    rng = random.Random(8)
    rows = []
    for i in range(1500):
        entity = "hot" if rng.random() < 0.6 else rng.choice([None, *(f"e{k}" for k in range(6))])
        rows.append((entity, T0 + timedelta(seconds=rng.randrange(400_000)), i, rng.choice([None, False, False, False]) if rng.random() < 0.9 else True))
    want = A.idle_episodes(spark.createDataFrame(rows, SAMPLE), threshold=1800)
    path = str(tmp_path / "in")
    write_in_turns(spark, path, late_order(rows, rng, 30_000) + [("end", END, -1, True)], SAMPLE, turns)
    feed = feeds.read_stream(spark, path, SAMPLE, files_per_trigger=1)
    got = feeds.run_available(idle.idle_alerts_stream(feed, 36_000, 1800), str(tmp_path / "run"))
    a, b = in_seq(want), in_seq(got)
    assert a == b and sum(r[6] for r in a) > 50


def idle_step(spark, tmp_path, rows, delay=0, at=None):
    """Add a file (and an instant), process them, and return all alerts so far of entity ``a``."""
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, SAMPLE).coalesce(1).write.mode("append").parquet(path)
    clock = tick(spark, str(tmp_path / "clock"), at or T0)
    stream = idle.idle_alerts_stream(feeds.read_stream(spark, path, SAMPLE), delay, clock=clock)
    out = feeds.run_available(stream, str(tmp_path / "run")).where("entity = 'a'").collect()
    assert len({r["seq"] for r in out}) == len(out)
    return {r["seq"]: r["alert"] for r in out}


def test_idle_stream_goes_on_after_a_restart(spark, tmp_path):
    at = [T0 + timedelta(seconds=s) for s in (1, 100, 1801, 1900, 2000)]
    assert idle_step(spark, tmp_path, [("a", at[0], 0, False), ("b", at[1], 9, True)]) == {0: False}
    # Nothing of ``a`` is released here; its timer is carried all the same.
    assert idle_step(spark, tmp_path, [("b", at[3], 10, True), ("a", at[2], 1, False)]) == {0: False, 1: True}
    assert idle_step(spark, tmp_path, [("b", at[4], 11, True)]) == {0: False, 1: True}
    last = idle_step(spark, tmp_path, [("a", at[4] + timedelta(seconds=1), 2, False)], at=END)
    assert last == {0: False, 1: True, 2: True}


def test_late_and_undated_rows_are_dropped(spark, tmp_path):
    at = [T0 + timedelta(seconds=s) for s in range(0, 500, 100)]
    idle_step(spark, tmp_path, [("a", at[0], 0, False), ("a", at[4], 4, False), ("a", None, 9, True)], delay=150)
    got = idle_step(spark, tmp_path, [("a", at[2], 2, False), ("a", at[3], 3, True)], delay=150, at=END)
    assert sorted(got) == [0, 3, 4]


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], SAMPLE).write.parquet(str(tmp_path / "in"))
    feed = feeds.read_stream(spark, str(tmp_path / "in"), SAMPLE)
    assert feeds.run_available(idle.idle_alerts_stream(feed), str(tmp_path / "run")).count() == 0


def plain_expiry(log, ttl, end):
    """Times of last use after which a resource stayed idle for longer than ttl."""
    found = set()
    by_pod = {}
    for row in sorted(log, key=lambda r: (r[2], r[3])):
        by_pod.setdefault(row[0], []).append(row)
    for pod, rows in by_pod.items():
        status, used = None, None
        for (_, event, at, _), nxt in zip(rows, [*[r[2] for r in rows[1:]], end]):
            status = "idle" if event in ("succeeded", "failed") else "busy"
            used = used if event == "failed" else at
            if status == "idle" and used and (nxt - used).total_seconds() > ttl:
                found.add((pod, used))
    return found


def make_log(rng, n, hot):
    log = []
    for i in range(n):
        pod = "hot" if rng.random() < hot else f"p{rng.randrange(20)}"
        event = rng.choice(["created", "assigned", "succeeded", "failed"])
        log.append((pod, event, T0 + timedelta(seconds=rng.randrange(n * 110)), i))
    return log


@pytest.mark.parametrize("buckets, uses", [(1, True), (40, True), (40, False)])
def test_batch_expiry_equals_a_loop_with_a_hot_resource(spark, buckets, uses):
    log = make_log(random.Random(12), 2000, 0.7)
    if not uses:  # long stretches without any use
        log = [r if r[3] % 50 == 0 else (r[0], "failed", *r[2:]) for r in log]
    df = spark.createDataFrame(log, "pod_name string, event string, ts timestamp, seq long")
    got = P.idle_expiries(df.repartition(5), END, ttl=600, buckets=buckets).collect()
    want = plain_expiry(log, 600, END)
    assert len(got) == len(want) and {(r["pod_name"], r["last_used"]) for r in got} == want


@pytest.mark.parametrize("turns", [1, 4])
def test_expiry_stream_equals_a_loop(spark, tmp_path, turns):
    rng = random.Random(9)
    log = make_log(rng, 800, 0.4)
    path = str(tmp_path / "in")
    write_in_turns(spark, path, late_order(log, rng, 9_000) + [("end", "created", END, -1)], MOVES, turns)
    feed = feeds.read_stream(spark, path, MOVES, files_per_trigger=1)
    got = feeds.run_available(S.expire_idle_stream(feed, 10_800, 600), str(tmp_path / "run")).collect()
    want = plain_expiry(log, 600, END)
    assert len(got) == len(want) and {(r["pod_name"], r["last_used"]) for r in got} == want
    assert all(r["expired_at"] == r["last_used"] + timedelta(seconds=600) for r in got)


def test_a_timer_expires_a_resource_without_further_rows(spark, tmp_path):
    path, clock, root = (str(tmp_path / n) for n in ("in", "clock", "run"))
    at = [T0 + timedelta(seconds=s) for s in (10, 20, 620, 621)]
    log = [("a", "assigned", at[0], 0), ("a", "succeeded", at[1], 1), ("b", "assigned", at[1], 2), (None, "succeeded", at[1], 3)]
    spark.createDataFrame(log, MOVES).write.parquet(path)

    def told(now):
        feed = feeds.read_stream(spark, path, MOVES)
        found = feeds.run_available(S.expire_idle_stream(feed, 0, 600, tick(spark, clock, now)), root)
        return sorted(((r["pod_name"] or "", r["last_used"]) for r in found.collect()))

    assert told(at[2]) == []  # idle for 600 s exactly
    assert told(at[3]) == told(END) == [("", at[1]), ("a", at[1])]  # told once


@pytest.mark.parametrize("turns", [1, 4])
def test_pool_state_stream_equals_batch(spark, tmp_path, turns):
    rng = random.Random(10)
    log = []
    for i in range(600):
        event = rng.choice(["created", "assigned", "succeeded", "failed", "seen"])
        log.append((f"p{rng.randrange(15)}", event, T0 + timedelta(seconds=rng.randrange(9000)), i))
    schema = "pod_name string, event string, ts timestamp, seq long"
    path = str(tmp_path / "in")
    write_in_turns(spark, path, log, schema, turns)
    feed = feeds.read_stream(spark, path, schema, files_per_trigger=1)
    got = S.keep_state(S.pool_state_stream(feed), str(tmp_path / "run"))
    want = P.latest_state(spark.createDataFrame(log, schema))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stateless_streams(spark, tmp_path):
    schema = "kernels_status int, kernels string, terminals_status int, terminals string, sessions int"
    spark.createDataFrame([(200, "[]", 200, '[{"name":"1"}]', 0), (403, "[]", 403, "[]", 0)], schema).write.parquet(
        str(tmp_path / "s")
    )
    out = feeds.activity_stream(feeds.read_stream(spark, str(tmp_path / "s"), schema))
    got = feeds.run_available(out, str(tmp_path / "sr"))
    assert sorted(r["active"] for r in got.collect()) == [False, True]

    asked = spark.createDataFrame([("q", "c"), ("", "c")], "question string, context string")
    asked.write.parquet(str(tmp_path / "q"))
    feed = feeds.read_stream(spark, str(tmp_path / "q"), asked.schema)
    answers = feeds.answer_stream(feed, lambda: (lambda prompts: [p.upper() + " " for p in prompts]))
    rows = feeds.run_available(answers, str(tmp_path / "qr")).collect()
    assert [(r["sql"], r["prompt"]) for r in rows] == [
        ("TRANSLATE ENGLISH TO SQL: Q </S> TABLES: C", "translate English to SQL: q </s> Tables: c")
    ]


def test_cells_are_plain_values():
    from corpusflow.streaming.stateful import _cells

    assert _cells(pd.Series([1.0, None])) == [1.0, None] and _cells(pd.Series([True, False]))[0] is True
    assert _cells(pd.Series([True, None, pd.NA, pd.NaT, "a"], dtype=object)) == [True, None, None, None, "a"]
