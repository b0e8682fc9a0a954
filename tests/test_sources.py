import glob
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusflow import session as N
from corpusflow.sources import history as H, tables as T


def numbers(spark, n):
    return spark.range(n).select(((F.col("id") * 7919) % n).alias("id"), F.lit("x").alias("s"))


@pytest.mark.parametrize("n", [0, 1, 999, 1000, 1001, 4321])
def test_shards_round_trip_in_order(spark, tmp_path, n):
    path = str(tmp_path / "raw")
    T.write_shards(numbers(spark, n).repartition(5), path, ["id"], 1000)
    files = glob.glob(path + "/shard_id=*/*.parquet")
    assert len(files) == -(-n // 1000)
    if n == 0:
        return
    back = T.read_shards(spark, path)
    assert sorted((r["ord"], r["id"]) for r in back.collect()) == [(i, i) for i in range(n)]
    assert back.columns == ["id", "s", "ord"]
    stored = {r["shard_id"]: r["count"] for r in spark.read.parquet(path).groupBy("shard_id").count().collect()}
    assert stored == {i // 1000: min(1000, n - i) for i in range(0, n, 1000)}


def test_no_stale_shards_and_number_order(spark, tmp_path):
    path = str(tmp_path / "raw")
    T.write_shards(numbers(spark, 120), path, ["id"], 10)
    assert [r["id"] for r in T.read_shards(spark, path).orderBy("ord").collect()] == list(range(120))
    T.write_shards(numbers(spark, 15), path, ["id"], 10)
    assert T.read_shards(spark, path, ordinal=None).count() == 15
    known = T.read_shards(spark, path, ordinal=None).schema
    assert T.read_shards(spark, path, ordinal=None, schema=known).count() == 15


def test_siblings_and_other_files(spark, tmp_path):
    T.write_table(spark.range(3), str(tmp_path / "raw"))
    T.write_table(spark.range(3, 5).withColumn("extra", F.lit(1)), str(tmp_path / "raw_old"))
    (tmp_path / "raw" / "note.txt").write_text("x")
    assert T.read_shards(spark, str(tmp_path / "raw")).count() == 3
    both = T.read_shards(spark, str(tmp_path / "raw"), siblings=True)
    assert both.count() == 5 and "extra" in both.columns
    names = [r["name"] for r in T.list_files(spark, str(tmp_path / "raw")).collect()]
    assert "note.txt" in names
    only = T.list_files(spark, str(tmp_path / "raw"), "*.parquet").collect()
    assert all(r["name"].endswith(".parquet") and r["length"] > 0 for r in only)


def test_read_split_prunes_folders(spark, tmp_path):
    path = str(tmp_path / "splits")
    df = spark.range(30).withColumn("split", F.when(F.col("id") < 20, "train").otherwise("val"))
    T.write_splits(df, path)
    val = T.read_split(spark, path, "val")
    assert val.columns == ["id"] and val.count() == 10
    plan = val._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_examples_are_checked(spark, tmp_path):
    good = spark.createDataFrame([("c", "q", "a", 1)], "context string, question string, answer string, n int")
    T.write_table(good, str(tmp_path / "good"))
    assert tuple(T.read_examples(spark, str(tmp_path / "good")).first()) == ("q", "c", "a")
    T.write_table(good.withColumn("answer", F.lit(1)).drop("context"), str(tmp_path / "bad"))
    with pytest.raises(T.SchemaMismatch) as failure:
        T.read_examples(spark, str(tmp_path / "bad"))
    assert "answer" in str(failure.value) and "context" in str(failure.value)
    good.write.json(str(tmp_path / "json"))
    assert T.read_examples(spark, str(tmp_path / "json"), "json").first()["question"] == "q"


def test_history_keeps_every_entry(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = [("r", 0.1, datetime(2024, 1, 1)), ("r", 0.2, datetime(2024, 1, 2))]
    df = spark.createDataFrame(rows, "run string, loss double, at timestamp")
    H.append_metrics(H.metric_rows(df, "run", {"eval_loss": "loss"}, at="at"), path)
    H.append_metrics(H.table_rows(df.select("run", "loss"), "run", "t.json", at=F.lit("2024-01-03")), path)
    log = H.read_metrics(spark, path)
    assert log.count() == 4
    latest = {(r["kind"], r["key"]): r["value"] for r in H.latest_metrics(log).collect()}
    assert latest[("metric", "eval_loss")] == "0.2"
    assert '"loss":0.2' in latest[("table", "t.json")]
    with pytest.raises(ValueError):
        H.metric_rows(df, "run", {}, "nonsense")


def test_materialize_reuses_only_the_same_version_and_inputs(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(len(calls))

    def run(version, inputs):
        return H.materialize(spark, "step", version, inputs, build, str(tmp_path)).count()

    assert [run("1", {"a": 1}), run("1", {"a": 1}), run("1", {"a": 2}), run("2", {"a": 1})] == [1, 1, 2, 3]
    unfinished = H.step_path(str(tmp_path), "step", "3", {})
    spark.range(9).write.parquet(unfinished)
    (tmp_path / unfinished.removeprefix(str(tmp_path) + "/") / "_SUCCESS").unlink()
    assert run("3", {}) == 4


def test_session_conf():
    conf = N.session_conf()
    assert conf["spark.executor.instances"] == "2" and conf["spark.executor.memory"] == "4g"
    assert conf["spark.driver.cores"] == "1" and conf["spark.dynamicAllocation.enabled"] == "false"
    assert conf["spark.hadoop.fs.s3a.impl"].endswith("S3AFileSystem")
    conf = N.session_conf(
        {"spark.executor.memory": "8g", "spark.dynamicAllocation.enabled": "true"},
        {"fs.s3a.impl": "other"},
        executor_memory="6g",
        executor_cores=4,
    )
    assert conf["spark.executor.memory"] == "8g" and conf["spark.executor.cores"] == "4"
    assert conf["spark.dynamicAllocation.enabled"] == "true"
    assert conf["spark.hadoop.fs.s3a.impl"] == "other"
    with pytest.raises(TypeError):
        N.session_conf(executor_speed=1)


def test_spark_task_passes_a_session(spark, tmp_path):
    @N.spark_task(app_name="tests")
    def clean(session, source, target):
        """Keep complete rows."""
        from corpusflow.operators.prepare import clean_rows

        T.write_table(clean_rows(session.read.parquet(source)), target)
        return target

    T.write_table(spark.createDataFrame([("a",), (None,)], "text string"), str(tmp_path / "in"))
    assert clean.__doc__ == "Keep complete rows."
    assert spark.read.parquet(clean(str(tmp_path / "in"), str(tmp_path / "out"))).count() == 1


def test_shared_folder_comes_from_the_session(spark):
    assert N.scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_scratch_is_cleared(spark):
    from corpusflow.session import clear_scratch, scratch_path

    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    assert clear_scratch(spark) >= 1 and clear_scratch(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_no_folder_is_an_error(spark, monkeypatch):
    from types import SimpleNamespace

    from corpusflow import session

    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(applicationId="bare"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_path(bare, "x")
    session.use_folder(bare, "file:///shared")
    assert session.scratch_path(bare, "x").startswith("file:///shared/x-")
