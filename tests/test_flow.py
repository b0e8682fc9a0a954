import pytest
from pyspark.sql import functions as F

from corpusflow.operators import prepare as P
from corpusflow.plans import dataset as D
from corpusflow.sources import history as H, tables as T


def answer_well_on_even():
    """Right for even questions, wrong text but same rows for the others."""

    def predict(prompts):
        out = []
        for p in prompts:
            n = int(p.split("number ")[1].split(" ")[0])
            out.append(f"SELECT  a from t WHERE a = {n}" if n % 2 == 0 else "SELECT a FROM t")
        return out

    return predict


@pytest.mark.parametrize("holdout", ["split", "tail"])
def test_from_examples_to_metrics(spark, tmp_path, holdout):
    examples = spark.range(300).select(
        F.format_string("number %d ?", "id").alias("question"),
        F.lit("CREATE TABLE t (a INT)").alias("context"),
        F.format_string("SELECT a FROM t WHERE a = %d", "id").alias("answer"),
        F.col("id"),
    )
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    settings = D.DatasetSettings(source_length=40, target_length=16, shard_rows=70)
    D.ingest(examples, raw, ["id"], settings)
    D.preprocess(spark, raw, out, lambda: P.code_points, settings, holdout)
    encoded = spark.read.parquet(out + "/encoded")
    counts = {r["split"]: r["rows"] for r in P.split_counts(encoded).collect()}
    assert counts == {"train": 240, "val": 30, "test": 30}
    one = T.read_split(spark, out + "/encoded", "val").first()
    assert len(one["input_ids"]) == len(one["attention_mask"]) == 40 and len(one["labels"]) == 16

    log = str(tmp_path / "history")
    summary = D.evaluate(spark, out, "s3a://b/checkpoints/run-1/", answer_well_on_even, log).first()
    kept = spark.read.parquet(out + "/test_raw")
    even = kept.where("ord % 2 = 0").count() / kept.count()
    assert summary["run_id"] == "run-1" and summary["num_examples"] == 30
    assert summary["exact_match_accuracy"] == even and summary["execution_accuracy"] == 1.0

    entries = H.read_metrics(spark, log)
    metrics = {r["key"]: float(r["value"]) for r in entries.where("kind = 'metric'").collect()}
    assert metrics == {"test_exact_match": even, "test_execution_accuracy": 1.0}
    assert entries.where("kind = 'table'").count() == 20
    text = entries.where("kind = 'text'").first()["value"]
    assert text == f"Exact Match: {even:.4f}\nExecution Accuracy: 1.0000"
