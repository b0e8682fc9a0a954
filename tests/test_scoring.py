import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import scoring as S

TWO_TABLES = "CREATE TABLE t (a TEXT, b INT); create table u (c INT); INSERT INTO t VALUES ('x', 1)"

# What a query gives on the empty tables of its context, written out: the rows, or None if it fails.
OUTCOMES = [
    (TWO_TABLES, "SELECT a FROM t", []),
    (TWO_TABLES, "select  A from T where b = 3", []),
    (TWO_TABLES, "SELECT c FROM u", []),
    (TWO_TABLES, "SELECT count(*) FROM t", [(0,)]),
    (TWO_TABLES, "SELECT count(*), 0 FROM t", [(0, 0)]),
    (TWO_TABLES, 'SELECT "nope" FROM t', []),
    (TWO_TABLES, "SELECT nope FROM t", None),
    (TWO_TABLES, "SELECT 1; SELECT 2", None),
    (TWO_TABLES, "SELECT 1", [(1,)]),
    (TWO_TABLES, "SELECT 1.0", [(1,)]),
    (TWO_TABLES, "SELECT '1'", [("1",)]),
    (TWO_TABLES, "SELECT NULL", [(None,)]),
    (TWO_TABLES, "SELECT 1 UNION ALL SELECT 2", [(1,), (2,)]),
    (TWO_TABLES, "SELECT 2 UNION ALL SELECT 1", [(2,), (1,)]),
    (TWO_TABLES, "INSERT INTO t (a) VALUES ('z')", []),
    (TWO_TABLES, "DROP TABLE t", []),
    (TWO_TABLES, "WITH x AS (SELECT 1) SELECT * FROM x", [(1,)]),
    (TWO_TABLES, "", []),
    (TWO_TABLES, None, None),
    ("CREATE TABLE t (a TEXT DEFAULT 'x;y')", "SELECT 1", None),
    ("CREATE TABLE broken (", "SELECT 1", None),
    ("", "SELECT 1", [(1,)]),
    ("", "SELECT a FROM t", None),
    (None, "SELECT 1", None),
]


@pytest.mark.parametrize("parts", [1, 5])
def test_execution_match_by_written_outcomes(spark, parts):
    pairs = [(c, p, g, x is not None and x == y) for c, p, x in OUTCOMES for d, g, y in OUTCOMES if c == d]
    rows = [(i, c, p, g) for i, (c, p, g, _) in enumerate(pairs)]
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, "i int, context string, predicted string, answer string")
    got = {r["i"]: r["exec_match"] for r in S.execution_match(df.repartition(parts)).collect()}
    assert got == {i: same for i, (*_, same) in enumerate(pairs)} and sum(got.values()) > 30


def test_execution_is_contained(spark, tmp_path):
    target = tmp_path / "x.db"
    fetch = S._fetcher(200_000)
    ddl = ("CREATE TABLE t (a)",)
    for sql in (f"ATTACH '{target}' AS x", f"VACUUM INTO '{target}'", "SELECT load_extension('x')", "SELECT '\ud800'"):
        assert fetch(ddl, sql) == ("failed", None)
    endless = "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r) SELECT max(n) FROM r"
    assert fetch(ddl, endless) == fetch(ddl, "SELECT zeroblob(100000000)") == ("limit", None)
    assert not target.exists()
    assert fetch(ddl, "SELECT a FROM t")[0] == "ok"


def test_private_changes_do_not_leak(spark):
    fetch = S._fetcher(S.SQL_STEPS)
    ddl = ("CREATE TABLE t (a)",)
    nothing, zero = fetch(ddl, "SELECT a FROM t WHERE 0"), fetch(ddl, "SELECT 0")
    assert fetch(ddl, "INSERT INTO t VALUES (1)") == nothing
    assert fetch(ddl, "SELECT * FROM t") == nothing
    assert fetch(ddl, "DROP TABLE t") == nothing
    assert fetch(ddl, "SELECT count(*) FROM t") == zero


def test_chance_is_not_remembered(spark):
    fetch = S._fetcher(S.SQL_STEPS)
    assert fetch((), "SELECT random()") != fetch((), "SELECT random()")
    df = spark.createDataFrame([("", "SELECT random()", "SELECT random()")], "context string, predicted string, answer string")
    assert [(r.exec_match, r.exec_status) for r in S.execution_match(df).collect()] == [(False, "ok")]


def test_large_results_take_no_memory(spark):
    fetch = S._fetcher(S.SQL_STEPS * 10)
    many = "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 60) SELECT zeroblob(9000000) FROM r"
    tracemalloc.start()
    assert fetch((), many)[0] == "ok"
    assert tracemalloc.get_traced_memory()[1] < 120_000_000  # one row and its text, not 540 MB
    tracemalloc.stop()


def test_limits_are_told(spark):
    long = "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 3000000) SELECT count(*) FROM r"
    rows = [("r", "", long, long), ("r", "", "SELECT x", "SELECT 1"), ("r", "", "SELECT 1", "SELECT 1")]
    df = spark.createDataFrame(rows, "run_id string, context string, predicted string, answer string")
    judged = S.execution_match(df, steps=1_000_000).withColumn("exact_match", F.lit(False))
    assert sorted(r.exec_status for r in judged.collect()) == ["failed", "limit", "ok"]
    assert S.evaluation_summary(judged).first()["limited"] == 1
    enough = S.execution_match(df, steps=200_000_000).where(F.col("predicted") == long).first()
    assert enough["exec_match"] and enough["exec_status"] == "ok"


def test_accuracy_and_summary(spark):
    rows = [("r", True, True), ("r", False, None), ("s", False, True), ("s", None, False)]
    df = spark.createDataFrame(rows, "run_id string, exact_match boolean, exec_match boolean")
    got = {r["run_id"]: tuple(r)[1:] for r in S.evaluation_summary(df).collect()}
    assert got == {"r": (0.5, 0.5, 2, 0), "s": (0.0, 0.5, 2, 0)}
    whole = S.evaluation_summary(df, run=None).first()
    assert tuple(whole) == (0.25, 0.5, 4, 0)
    none = S.evaluation_summary(df.limit(0), run=None).first()
    assert none["num_examples"] == 0 and none["exact_match_accuracy"] is None
    table = {(r[0], r[1]): r["rows"] for r in S.agreement_table(df).collect()}
    assert table == {(True, True): 1, (False, None): 1, (False, True): 1, (None, False): 1}


class Counting:
    """Predictor that reports the size of the batch it saw."""

    def __call__(self, prompts):
        return [f" {p}/{len(prompts)} " for p in prompts]


def test_predict_in_batches_and_strip(spark):
    df = spark.range(100).coalesce(1).select(F.col("id").cast("string").alias("prompt"))
    got = [r["predicted"].split("/") for r in S.predict_batch(df, Counting, batch=16).collect()]
    assert sorted(int(g[0]) for g in got) == list(range(100))
    assert all(1 <= int(g[1]) <= 16 for g in got)


def test_score_requests_skips_rejected(spark):
    df = spark.createDataFrame([("q", "c"), ("", "c"), ("q", None)], "question string, context string")
    got = S.score_requests(df, Counting).collect()
    prompt = "translate English to SQL: q </s> Tables: c"
    assert [(r["sql"], r["prompt"]) for r in got] == [(f"{prompt}/1", prompt)]


def test_example_report(spark):
    df = spark.range(50).select(
        F.col("id").alias("ord"),
        F.lit("q").alias("question"),
        F.lit("A  b").alias("predicted"),
        F.when(F.col("id") % 2 == 0, "a B").otherwise("c").alias("answer"),
    )
    got = S.example_report(df, ["ord"]).collect()
    assert len(got) == 20 and [r["exact_match"] for r in got] == [True, False] * 10


def same(spark, a, b, ordinal="ord"):
    def frame(rows):
        if rows is None:
            return None
        return spark.createDataFrame(
            [(i, *r) for i, r in enumerate(rows)], "ord long, a int, b string"
        )

    x, y = frame(a), frame(b)
    if ordinal is None:
        x, y = (f.drop("ord") if f is not None else None for f in (x, y))
    return S.same_result(spark, x, y, ordinal).first()["same"]


def test_same_result(spark):
    rows = [(1, "x"), (1, "x"), (None, None), (2, "y")]
    assert same(spark, rows, rows)
    assert not same(spark, rows, rows[::-1]) and same(spark, rows, rows[::-1], None)
    assert not same(spark, rows, rows[1:]) and not same(spark, rows, rows[1:], None)
    assert not same(spark, [(1, "x")] * 3, [(1, "x")] * 2, None)
    assert same(spark, [], []) and not same(spark, [], None) and not same(spark, None, None)
