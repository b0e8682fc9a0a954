"""From raw shards to encoded splits, and from a held-out split to metrics."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusflow.functions import text as X
from corpusflow.operators import prepare, scoring
from corpusflow.operators.ordinal import head
from corpusflow.sources import history, tables


@dataclass(frozen=True)
class DatasetSettings:
    """Lengths, shares and seed of a dataset build."""

    source_length: int = 512
    target_length: int = 128
    test: float = 0.2
    val_share: float = 0.5
    seed: int = 42
    shard_rows: int = tables.SHARD_ROWS


def ingest(examples: DataFrame, path: str, keys: Sequence[str], settings=DatasetSettings()) -> str:
    """Store the examples as shards of consecutive rows."""
    tables.write_shards(examples, path, keys, settings.shard_rows)
    return path


def preprocess(
    spark: SparkSession,
    raw: str,
    out: str,
    load_encoder: Callable[[], Callable],
    settings=DatasetSettings(),
    holdout: str = "split",
) -> str:
    """Format, encode and split the shards below ``raw``.

    Writes ``encoded/split=...`` and the raw held-out rows ``test_raw``. The numbered
    rows are stored first, because the split and the tail read them several times.
    """
    numbered = posixpath.join(out, "numbered")
    tables.write_table(tables.read_shards(spark, raw), numbered)
    rows = spark.read.parquet(numbered)
    sizes = {"test": settings.test, "val_share": settings.val_share, "seed": settings.seed}
    split = prepare.split_rows(rows, "ord", **sizes)
    pairs = split.select(
        "ord",
        "split",
        X.format_prompt("question", "context").alias("input_text"),
        F.col("answer").alias("target_text"),
    )
    encoded = prepare.encode_text(
        pairs,
        load_encoder,
        source_length=settings.source_length,
        target_length=settings.target_length,
    )
    tables.write_splits(encoded, posixpath.join(out, "encoded"))
    kept = prepare.raw_holdout(rows, "ord", ["ord"], holdout, **sizes)
    tables.write_table(kept, posixpath.join(out, "test_raw"))
    return out


def score(
    rows: DataFrame, load_model: Callable[[], Callable], run_id, predicted: str = "predicted"
) -> DataFrame:
    """Predict, then judge by text and by execution. ``run_id``: a column or a value."""
    prompted = rows.withColumn("prompt", X.format_prompt("question", "context"))
    judged = scoring.execution_match(
        scoring.predict_batch(prompted, load_model, "prompt", predicted), predicted=predicted
    )
    return judged.withColumn("exact_match", X.exact_match(predicted, "answer")).withColumn(
        "run_id", run_id if not isinstance(run_id, str) else F.lit(run_id)
    )


def evaluate(
    spark: SparkSession,
    processed: str,
    checkpoint_path: str,
    load_model: Callable[[], Callable],
    history_path: str,
    limit: int | None = None,
) -> DataFrame:
    """Score the held-out rows of a dataset and log metrics, summary and examples.

    The run id is the last part of ``checkpoint_path``. ``limit`` keeps the first rows
    only, as a fast check; None scores all of them.
    """
    rows = spark.read.parquet(posixpath.join(processed, "test_raw"))
    if limit is not None:
        rows = head(rows, limit, ["ord"])
    run_id = posixpath.basename(checkpoint_path.rstrip("/"))
    scored_path = posixpath.join(processed, "scored", run_id)
    tables.write_table(score(rows, load_model, run_id), scored_path)
    scored = spark.read.parquet(scored_path)

    # Metric and artifact names.
    summary = scoring.evaluation_summary(scored)
    metrics = history.metric_rows(
        summary,
        "run_id",
        {
            "test_exact_match": "exact_match_accuracy",
            "test_execution_accuracy": "execution_accuracy",
        },
    )
    wording = X.summary_text("exact_match_accuracy", "execution_accuracy")
    text = history.metric_rows(
        summary.withColumn("_text", wording), "run_id", {"eval_summary.txt": "_text"}, "text"
    )
    examples = scoring.example_report(scored, ["ord"])
    table = history.table_rows(examples, F.lit(run_id), "eval_examples.json")
    history.append_metrics(prepare.concat_tables([metrics, text, table]), history_path)
    return summary
