import bisect
import random

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import ordinal as O


def driver_order(key):
    """Nulls first, then by value: the order Spark sorts text and numbers in."""
    return tuple((v is not None, v) for v in key.values())


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows share one key; some keys are null."""
    rng = random.Random(1)
    keys = ["hot"] * 4000 + [rng.choice(["", "é", "z\U0001f600", "zz", None]) for _ in range(2000)]
    rows = [(k, i, rng.randrange(50)) for i, k in enumerate(keys)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, i int, v int").cache()


def expected(rows, key):
    return {r["i"]: n for n, r in enumerate(sorted(rows, key=key))}


def by_key(r):
    return (r["k"] is not None, r["k"] or "", r["i"])


@pytest.mark.parametrize("parts, buckets", [(1, 1), (3, 8), (8, 300)])
def test_global_ordinal_is_dense_and_exact(skewed, parts, buckets):
    placed = O.global_ordinal(skewed.repartition(parts), ["k", "i"], buckets=buckets)
    got = {r["i"]: r["ord"] for r in placed.collect()}
    assert got == expected(skewed.collect(), by_key)


def test_hot_key_is_spread_over_buckets(skewed):
    cuts = O.cut_points(skewed, ["k", "i"], 16)
    sizes = [r["count"] for r in O.with_bucket(skewed, ["k", "i"], cuts).groupBy("_bucket").count().collect()]
    assert len(sizes) == len(cuts) + 1 == 16
    assert max(sizes) < 6000 / 16 * 2


@pytest.mark.parametrize("buckets", [2, 3, 8, 9, 500])
def test_bucket_is_the_number_of_cuts_at_or_below(skewed, buckets):
    cuts = O.cut_points(skewed, ["k", "i"], buckets)
    assert len(cuts) == buckets - 1
    bounds = [driver_order(c) for c in cuts]
    for r in O.with_bucket(skewed, ["k", "i"], cuts).collect():
        key = driver_order({"k": r["k"], "i": r["i"]})[: len(bounds[0])]
        assert r["_bucket"] == bisect.bisect_right(bounds, key)


def test_one_field_is_enough_without_a_hot_value(skewed):
    assert all(list(c) == ["k0"] for c in O.cut_points(skewed, ["i", "k"], 40))
    assert any(len(c) == 2 for c in O.cut_points(skewed, ["k", "i"], 40))
    placed = O.global_ordinal(skewed, ["i", "k"], buckets=40).collect()
    assert all(r["ord"] == r["i"] for r in placed)


@pytest.mark.parametrize("parts, buckets", [(1, 5), (8, 100)])
def test_group_ordinal(skewed, parts, buckets):
    placed = O.group_ordinal(skewed.repartition(parts), ["k"], ["v", "i"], buckets=buckets)
    counts = {}
    want = {}
    for r in sorted(skewed.collect(), key=lambda r: (r["v"], r["i"])):
        want[r["i"]] = counts.get(r["k"], 0)
        counts[r["k"]] = want[r["i"]] + 1
    assert {r["i"]: r["ord"] for r in placed.collect()} == want


def test_aligned_ordinal_never_cuts_a_run(skewed):
    placed = O.aligned_ordinal(skewed, ["k", "i"], 16).cache()
    assert {r["i"]: r["ord"] for r in placed.collect()} == expected(skewed.collect(), by_key)
    runs = placed.groupBy(F.floor(F.col("ord") / 16).alias("run")).agg(
        F.count_distinct("_bucket").alias("n")
    )
    assert runs.where("n > 1").count() == 0
    assert placed.select("_bucket").distinct().count() > 1


@pytest.mark.parametrize("n", [0, 1, 250, 5999, 6000, 7000])
def test_head_and_tail(skewed, monkeypatch, n):
    order = sorted(skewed.collect(), key=by_key)
    for limit in (10_000, -1):  # sorted limit, then the way for large n
        monkeypatch.setattr(O, "TOP_ROWS", limit)
        assert {r["i"] for r in O.head(skewed, n, ["k", "i"]).collect()} == {r["i"] for r in order[:n]}
        got = O.tail(skewed, n, ["k", "i"]).collect()
        assert len(got) == min(n, 6000)
        assert {r["i"] for r in got} == {r["i"] for r in order[max(0, 6000 - n):]}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "k string, i int")
    assert O.global_ordinal(empty, ["k", "i"]).collect() == []
    assert O.aligned_ordinal(empty, ["k", "i"], 4).collect() == []


def test_zip_stops_at_the_shorter_side(spark):
    left = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "ord long, l string")
    right = spark.createDataFrame([(0, "x"), (1, "y")], "ord long, r string")
    assert sorted(map(tuple, O.zip_columns(left, right).collect())) == [(0, "a", "x"), (1, "b", "y")]


def test_sort_files_by_number(spark):
    names = ["raw/shard_10000.parquet", "raw/shard_9999.parquet", "raw/shard_0001.parquet", "raw/other.parquet"]
    files = spark.createDataFrame([(n,) for n in names], "path string")
    got = O.sort_files(files).orderBy("position").collect()
    assert [r["path"] for r in got] == [names[3], names[2], names[1], names[0]]


def test_unsupported_key_is_refused(spark):
    df = spark.createDataFrame([(1.0,)], "d double")
    with pytest.raises(TypeError):
        O.global_ordinal(df, ["d"])


@pytest.mark.parametrize("name", ["global_ordinal", "group_ordinal", "aligned_ordinal"])
def test_no_data_goes_to_a_single_partition(skewed, name):
    build = {
        "global_ordinal": lambda: O.global_ordinal(skewed, ["k", "i"]),
        "group_ordinal": lambda: O.group_ordinal(skewed, ["k"], ["i"]),
        "aligned_ordinal": lambda: O.aligned_ordinal(skewed, ["k", "i"], 16),
    }[name]
    plan = build()._jdf.queryExecution().executedPlan().toString()
    singles = [i for i, line in enumerate(plan.splitlines()) if "SinglePartition" in line]
    # The counts, one row per bucket, are the only input of a one-partition exchange.
    lines = plan.splitlines()
    assert all("HashAggregate" in lines[i + 1] for i in singles)
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("n", [10, 1000, 1001, 4200, 5000, 9000])
def test_head_and_tail_are_exact_and_sorted(skewed, n):
    keys = [r["k"] for r in skewed.collect()]
    order = sorted(keys, key=lambda k: (k is not None, k or ""))
    assert [r["k"] for r in O.head(skewed, n, ["k"]).collect()] == order[:n]
    assert [r["k"] for r in O.tail(skewed, n, ["k"]).collect()] == order[::-1][:n]
    assert len({r["i"] for r in O.head(skewed, n, ["k"]).collect()}) == min(n, len(keys))


def test_any_key_type(skewed):
    df = skewed.withColumn("x", F.col("i") / 7)
    for n in (5, 2000):
        assert [r["i"] for r in O.head(df, n, ["x"]).collect()] == list(range(n))


def test_long_hot_keys_are_cut(spark):
    hot, other = "h" * 300, "h" * 299
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 < 2, F.lit(hot)).otherwise(F.concat(F.lit(other), F.col("id"))).alias("k"), "id"
    )
    cuts = O.cut_points(df, ["k", "id"], 16)
    sizes = [r["count"] for r in O.with_bucket(df, ["k", "id"], cuts).groupBy("_bucket").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 20_000 / 16


def test_buckets_follow_bytes(spark, monkeypatch):
    df = spark.range(4000).select("id", F.expr("repeat('x', 1000)").alias("t"))
    monkeypatch.setattr(O, "BUCKET_BYTES", 100_000)
    assert 35 <= len(O.cut_points(df, ["id"])) <= 45
    assert len(O.cut_points(df.select("id"), ["id"])) == spark.sparkContext.defaultParallelism - 1


def test_repeated_keys_get_exact_positions(spark):
    df = spark.range(5000).select((F.col("id") % 37).alias("k"), "id")
    placed = O.aligned_ordinal(df, ["k"], 16).collect()
    assert sorted(r["ord"] for r in placed) == list(range(5000))
    assert [r["k"] for r in sorted(placed, key=lambda r: r["ord"])] == sorted(r["k"] for r in placed)
    assert sorted(r.ord for r in O.aligned_ordinal(df.select("k"), ["k"], 16).collect()) == list(range(df.count()))


def test_a_slice_cannot_begin_inside_equal_keys(spark):
    df = spark.range(100).select(F.lit(1).alias("k"), "id")
    with pytest.raises(Exception, match="key repeats"):
        O.tail_where(df, F.lit(10), ["k"]).collect()


@pytest.mark.parametrize("copies", [100_000, 7])
def test_equal_rows_are_numbered(spark, monkeypatch, copies):
    """One row holds most of the table; nulls, maps, and rows that differ in a map only."""
    monkeypatch.setattr(O, "COPIES", copies)
    rows = [(1, None, {"a": 1})] * 400 + [(None, 1, {"a": 1})] * 90 + [(1, None, {"a": 2, "b": 3})] * 70 + [(1, 2, None)] * 3
    df = spark.createDataFrame(rows, "k long, v long, m map<string,int>").repartition(5)
    placed = O.aligned_ordinal(df, ["k"], 10).collect()
    assert placed[0].asDict().keys() == {"k", "v", "m", "_bucket", "ord"}
    assert sorted(r.ord for r in placed) == list(range(len(rows)))
    kinds = lambda rs: sorted(str((r[0], r[1], sorted((r[2] or {}).items()))) for r in rs)
    assert kinds(placed) == kinds(rows)
    assert all(r.k is None for r in placed if r.ord < 90)
    owners = {}
    for r in placed:
        owners.setdefault(r.ord // 10, set()).add(r._bucket)
    assert all(len(b) == 1 for b in owners.values()) and len({r._bucket for r in placed}) > 1


def test_shards_and_batches_of_equal_rows(spark, tmp_path):
    from corpusflow.operators.prepare import collate_batches
    from corpusflow.sources import tables

    rows = spark.range(25_000).select(F.lit("same").alias("text"))
    tables.write_shards(rows, str(tmp_path / "out"), ["text"])
    sizes = {r.shard_id: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("shard_id").count().collect()}
    assert sizes == {0: 10_000, 1: 10_000, 2: 5_000}
    ids = spark.range(1_000).select(F.array(F.lit(1), F.lit(2)).alias("input_ids"), F.lit("t").alias("k"))
    batches = collate_batches(ids, ["k"], {"input_ids": 0}, 16).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in batches) == [8] + [16] * 62


def test_hot_keys_are_told_apart_before_any_ranking(spark, monkeypatch):
    """Rows of one key are never ranked by that key alone, which would be one task's work."""
    df = spark.range(4000).select((F.col("id") % 3).alias("k")).repartition(4)
    ranked, placed = [], O._placed
    monkeypatch.setattr(O, "_placed", lambda rows, keys, *more: ranked.append(list(keys)) or placed(rows, keys, *more))
    found = O.aligned_ordinal(df, ["k"], 10, buckets=8)
    assert ranked and all("_copy" in keys for keys in ranked)
    assert sorted(r.ord for r in found.collect()) == list(range(4000))
    assert max(r["count"] for r in found.groupBy("_bucket").count().collect()) <= 500
    assert O._crowded(df, 512, 1000) and not O._crowded(spark.range(4000).select("id"), 512, 1000)


def test_a_hot_key_is_drawn_by_its_share(spark):
    """Three values, a third of the rows each: all are cut points, whatever their hashes are."""
    for first in range(0, 30, 3):
        df = spark.range(3000).select((F.col("id") % 3 + first).alias("k")).coalesce(1)
        assert {c["k0"] for c in O.cut_points(df, ["k"], 8)} >= {first + 1, first + 2}
