import random
from datetime import datetime, timedelta

import pytest

from corpusflow.operators import activity as A

T0 = datetime(2024, 1, 1)


def plain_timer(samples, threshold):
    """The rule as a loop per entity, samples in order."""
    since, out = {}, {}
    for entity, at, seq, active in sorted(samples, key=lambda r: (r[1], r[2])):
        if active:
            since.pop(entity, None)
            out[(entity, seq)] = (None, None, False)
        elif entity not in since:
            since[entity] = at
            out[(entity, seq)] = (at, 0.0, False)
        else:
            gone = (at - since[entity]).total_seconds()
            out[(entity, seq)] = (since[entity], gone, gone >= threshold)
    return out


def make_samples(n, seed, hot=0.7, busy=0.05):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        entity = "hot" if rng.random() < hot else f"e{rng.randrange(12)}"
        at = T0 + timedelta(seconds=rng.randrange(n * 3) * 10)
        rows.append((entity, at, i, rng.random() < busy))
    return rows


SCHEMA = "entity string, ts timestamp, seq long, active boolean"


def rows_of(df):
    return {
        (r["entity"], r["seq"]): (r["idle_since"], r["idle_seconds"], r["alert"]) for r in df.collect()
    }


@pytest.mark.parametrize("buckets, busy", [(1, 0.05), (8, 0.05), (60, 0.01), (60, 0.0), (60, 0.6)])
def test_idle_episodes_equal_a_loop_with_a_hot_entity(spark, buckets, busy):
    samples = make_samples(3000, 11, busy=busy)
    df = spark.createDataFrame(samples, SCHEMA).repartition(5)
    got = rows_of(A.idle_episodes(df, threshold=1800, buckets=buckets))
    assert got == plain_timer(samples, 1800)


def test_threshold_is_reached_at_equality(spark):
    rows = [("a", T0, 0, False), ("a", T0 + timedelta(seconds=1799), 1, False),
            ("a", T0 + timedelta(seconds=1800), 2, False), ("a", T0 + timedelta(seconds=1801), 3, True),
            ("a", T0 + timedelta(seconds=5000), 4, False)]
    got = rows_of(A.idle_episodes(spark.createDataFrame(rows, SCHEMA)))
    assert [got[("a", i)][2] for i in range(5)] == [False, False, True, False, False]
    zero = rows_of(A.idle_episodes(spark.createDataFrame(rows, SCHEMA), threshold=0))
    assert [zero[("a", i)][2] for i in range(5)] == [False, True, True, False, False]


@pytest.mark.parametrize(
    "kernels_status, kernels, terminals_status, terminals, sessions, active",
    [
        (200, '[{"id":"k1","execution_state":"busy"}]', 200, "[]", 0, True),
        (200, '[{"id":"k1","execution_state":"idle"}]', 200, "[]", 0, False),
        (200, "[]", 200, '[{"name":"1"}]', 0, True),
        (200, "[]", 200, "[]", 0, False),
        (403, '[{"id":"k1","execution_state":"busy"}]', 403, '[{"name":"1"}]', 0, False),
        (None, None, None, None, None, False),
        (None, None, 200, "broken", 2, True),
        (200, "broken", 200, '[{"name":"1"}]', 0, True),
    ],
)
def test_activity(spark, kernels_status, kernels, terminals_status, terminals, sessions, active):
    df = spark.createDataFrame(
        [(kernels_status, kernels, terminals_status, terminals, sessions)],
        "kernels_status int, kernels string, terminals_status int, terminals string, sessions int",
    )
    assert df.select(A.activity_predicate()).first()[0] is active


HEADER = "  sl  local_address rem_address   st"


def test_count_sessions(spark):
    def table(entity, lines):
        return [(entity, i, line) for i, line in enumerate(lines)]

    rows = (
        table("two", [HEADER] + [f" {i}: 0:{p} 0:0 01" for i, p in enumerate(["0016", "0016", "1F90"])])
        + table("listen", [HEADER, " 0: 0:0016 0:0 0A"])
        + table("empty", [HEADER])
        + table("first", [" 0: 0:0016 0:0 01"])
    )
    df = spark.createDataFrame(rows, "entity string, line_number int, line string")
    got = {r["entity"]: r["sessions"] for r in A.count_sessions(df, ["entity"]).collect()}
    assert got == {"two": 2, "listen": 0, "empty": 0, "first": 0}
