import base64
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import mapping as M, prepare as P


def test_clean_rows(spark):
    df = spark.createDataFrame([("a", 1), (None, 1), ("b", None)], "text string, n int")
    assert [tuple(r) for r in P.clean_rows(df).collect()] == [("a", 1)]


def test_first_broken_rule_names_the_reason(spark):
    rows = [("q", "c"), (" \xa0", "c"), ("q", "\n"), ("", ""), (None, "c"), ("q", None)]
    df = spark.createDataFrame(rows, "question string, context string")
    good, bad = P.validate_requests(df)
    assert [tuple(r) for r in good.collect()] == [("q", "c")]
    assert [r["detail"] for r in bad.collect()] == [
        P.NO_QUESTION, P.NO_CONTEXT, P.NO_QUESTION, P.NO_QUESTION, P.NO_CONTEXT,
    ]
    assert {r["code"] for r in bad.collect()} == {400}


def test_payload_limit_is_strict(spark):
    sizes = [674_997, 675_000, 675_001]
    assert len(base64.b64encode(bytes(675_000))) == P.PAYLOAD_LIMIT
    df = spark.createDataFrame([(n, bytes(n)) for n in sizes], "n int, payload binary")
    good, over = P.payload_guard(df)
    assert [r["n"] for r in good.collect()] == sizes[:2]
    assert [r["n"] for r in over.collect()] == sizes[2:]


def test_concat_tables_fills_gaps(spark):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    b = spark.createDataFrame([("y", 2.0)], "s string, d double")
    got = P.concat_tables([a, b, a]).collect()
    assert sorted(tuple(r) for r in got if r["i"]) == [(1, "x", None)] * 2
    assert [tuple(r) for r in got if not r["i"]] == [(None, "y", 2.0)]


def sizes(n, test=0.2, share=0.5):
    held = math.ceil(n * test)
    tested = math.ceil(held * share)
    return {"train": n - held, "val": held - tested, "test": tested}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 9, 10, 11, 101, 5000])
def test_split_sizes_are_exact(spark, n):
    got = {r["split"]: r["rows"] for r in P.split_counts(P.split_rows(spark.range(n), "id")).collect()}
    assert got == {k: v for k, v in sizes(n).items() if v}


def test_split_ignores_partitioning_and_follows_the_seed(spark):
    def members(df, seed=42):
        return {tuple(r) for r in P.split_rows(df, "id", seed=seed).collect()}

    df = spark.range(3000)
    one = members(df.repartition(1))
    assert one == members(df.repartition(7)) == members(df.orderBy(F.col("id").desc()))
    assert len(one) == 3000 and one != members(df, seed=7)


def test_holdout_modes(spark):
    df = spark.range(2000)
    split = P.split_rows(df, "id").cache()
    test = {r["id"] for r in split.where("split = 'test'").collect()}
    assert {r["id"] for r in P.raw_holdout(df, "id").collect()} == test
    tail = {r["id"] for r in P.raw_holdout(df, "id", ["id"], "tail").collect()}
    assert tail == set(range(1800, 2000))
    train = {r["id"] for r in split.where("split = 'train'").collect()}
    assert not test & train and len(tail & train) > 100
    with pytest.raises(ValueError):
        P.raw_holdout(df, "id", mode="other")


def test_split_shuffles_only_prefixes_that_are_cut(spark):
    plan = P.split_rows(spark.range(100_000), "id")._jdf.queryExecution().executedPlan().toString()
    assert "RangePartitioning" not in plan and "rangepartitioning" not in plan
    assert "SortMergeJoin" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("length", [0, 3, 4, 5])
def test_pad_truncate(spark, length):
    df = spark.createDataFrame([([1, 2, 3, 4],), ([],)], "a array<int>")
    got = df.select(P.pad_truncate("a", length, -100), P.attention_mask("a", length)).collect()
    want = [([1, 2, 3, 4] + [-100] * 9)[:length], [-100] * length]
    assert [r[0] for r in got] == want
    assert [r[1] for r in got] == [([1] * 4 + [0] * 9)[:length], [0] * length]


def test_encode_text(spark):
    df = spark.createDataFrame(
        [(1, "abc", "xy"), (2, None, "é" * 200)], "i int, input_text string, target_text string"
    )
    got = P.encode_text(df, lambda: P.code_points, source_length=5, target_length=4)
    rows = {r["i"]: r for r in got.collect()}
    assert got.columns == ["i", "input_ids", "attention_mask", "labels"]
    assert rows[1]["input_ids"] == [97, 98, 99, 0, 0] and rows[1]["attention_mask"] == [1, 1, 1, 0, 0]
    assert rows[1]["labels"] == [120, 121, 0, 0]
    assert rows[2]["input_ids"] == [78, 111, 110, 101, 0] and rows[2]["labels"] == [233] * 4


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_collate_batches(spark, parts):
    rng = random.Random(3)
    rows = [(i, [1] * rng.randrange(20), [2] * rng.randrange(9)) for i in range(203)]
    df = spark.createDataFrame(rows, "i int, ids array<int>, labels array<int>").repartition(parts)
    got = P.collate_batches(df, ["i"], {"ids": 0, "labels": -100}, 16).collect()
    want = {}
    for b in range(0, len(rows), 16):
        part = rows[b : b + 16]
        wide, long = max(len(r[1]) for r in part), max(len(r[2]) for r in part)
        for i, ids, labels in part:
            want[i] = (
                b // 16,
                ids + [0] * (wide - len(ids)),
                labels + [-100] * (long - len(labels)),
            )
    assert {r["i"]: (r["batch"], r["ids"], r["labels"]) for r in got} == want


def test_collate_shuffles_whole_rows_once(spark):
    df = spark.range(1000).select("id", F.array("id").cast("array<int>").alias("a"))
    plan = P.collate_batches(df, ["id"], {"a": 0})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def noisy(n, s):
    import sys

    print("out", n)
    print("err", file=sys.stderr)
    if n == 2:
        raise KeyError("two")
    if n == 3:
        return "not a number"
    return None if n is None else n * 10 + len(s)


@pytest.mark.parametrize("parts", [1, 4])
def test_safe_map_returns_errors_as_data(spark, parts):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "dd")], "n int, s string")
    got = {r["n"]: r for r in M.safe_map(df.repartition(parts), noisy, ["n", "s"], "long").collect()}
    assert (got[1]["return_value"], got[1]["ok"], got[1]["error"]) == (11, True, None)
    assert got[1]["stdout"] == "out 1\nerr\n"
    assert got[2]["ok"] is False and got[2]["error"] == "'two'" and "KeyError" in got[2]["traceback"]
    assert got[2]["return_value"] is None and got[2]["stdout"] == "out 2\nerr\n"
    assert got[3]["ok"] is False and got[3]["return_value"] is None
    assert got[4]["return_value"] == 42


def test_map_batches_sees_at_most_batch_size(spark):
    import pandas as pd

    def width(pdf):
        return pd.DataFrame({"n": [len(pdf)] * len(pdf)})

    got = M.map_batches(spark.range(1000).coalesce(1), width, "n long", 300, ["id"])
    assert got.columns == ["n"]
    assert got.count() == 1000 and got.agg(F.max("n")).first()[0] <= 300


def test_map_batches_may_change_length_without_kept_columns(spark):
    df = spark.range(40).coalesce(1)
    thrice = M.map_batches(df, lambda pdf: pd.DataFrame({"n": pdf["id"].repeat(3)}), "n long", 10, ["id"])
    assert sorted(r["n"] for r in thrice.collect()) == sorted(list(range(40)) * 3)
    few = M.map_batches(df, lambda pdf: pd.DataFrame({"n": pdf["id"].head(2)}), "n long", 10, ["id"])
    assert [r["n"] for r in few.collect()] == [0, 1, 10, 11, 20, 21, 30, 31]
    kept = M.map_batches(df, lambda pdf: pd.DataFrame({"n": pdf["id"].head(2)}), "n long", 10)
    with pytest.raises(Exception, match="2 rows for 10"):
        kept.collect()


def test_mapping_keeps_whole_numbers_with_nulls(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(big, 1), (big + 2, None), (None, 3)], "id long, n int").coalesce(1)
    called = M.safe_map(df, lambda n: type(n).__name__, ["n"], "string", ["id"]).collect()
    assert [(r["id"], r["return_value"]) for r in called] == [(big, "int"), (big + 2, "NoneType"), (None, "int")]
    mapped = M.map_batches(df, lambda pdf: pd.DataFrame({"t": [repr(x) for x in pdf["n"]]}), "t string").collect()
    assert [r["id"] for r in mapped] == [big, big + 2, None] and [r["t"] for r in mapped] == ["1", "None", "3"]


def test_one_pass_forms_agree_with_both_sides(spark):
    asked = spark.createDataFrame([("q", "c"), (" ", "c"), ("q", None)], "question string, context string")
    good, bad = P.validate_requests(asked)
    checked = P.checked_requests(asked).collect()
    assert good.count() == 1 and bad.count() == 2 and [r["code"] for r in checked] == [None, 400, 400]
    sized = P.sized_payloads(spark.createDataFrame([("abc",), ("abcdef",), (None,)], "payload string"), limit=4)
    assert [(r["encoded_length"], r["accepted"]) for r in sized.collect()] == [(4, True), (8, False), (None, True)]


def test_a_table_of_many_rows_is_dealt_out_by_rows(spark, monkeypatch):
    """Two partitions are a quarter of eight cores; 800 rows at 50 a task still want 16 tasks."""
    from corpusflow.operators import layout

    monkeypatch.setattr(layout, "SPREAD_ROWS", 50, raising=False)
    rows = spark.range(800, numPartitions=2)
    assert layout.spread(rows).rdd.getNumPartitions() == 16
    assert layout.spread(spark.range(800, numPartitions=8)).rdd.getNumPartitions() == 8


def test_encoder_sees_few_texts_at_once(spark):
    """What a call holds does not follow the size of an Arrow batch."""
    sizes = lambda: lambda texts: [[len(texts)] for _ in texts]
    df = spark.range(1000, numPartitions=1).select(F.lit("a").alias("input_text"), F.lit("b").alias("target_text"))
    found = [r.input_ids[0] for r in P.encode_text(df, sizes, source_length=1, target_length=1).collect()]
    assert len(found) == 1000 and max(found) <= 128
