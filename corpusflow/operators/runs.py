"""Checkpoints and model versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusflow.functions import state as S
from corpusflow.functions.text import model_uri


def best_checkpoint(df: DataFrame, run="run_id", name="name", loss="eval_loss") -> DataFrame:
    """Checkpoint with the lowest loss per run; the earlier step wins a tie."""
    scored = df.where(F.col(loss).isNotNull())
    order = F.struct(F.col(loss), S.checkpoint_step(name))
    return scored.groupBy(run).agg(
        F.min_by(name, order).alias("best"), F.min(loss).alias("best_loss")
    )


def checkpoint_listing(df: DataFrame, name="name", is_dir="is_dir") -> tuple[DataFrame, DataFrame]:
    """Checkpoint folders with their ``step``, and those whose suffix is no number."""
    folders = df.where(F.col(name).startswith("checkpoint-") & F.col(is_dir)).withColumn(
        "step", S.checkpoint_step(name)
    )
    return folders.where("step is not null"), folders.where("step is null").drop("step")


def latest_checkpoint(df: DataFrame, run="run_id", name="name", is_dir="is_dir") -> DataFrame:
    """Folder with the largest step number per run, compared as a number."""
    good, _ = checkpoint_listing(df, name, is_dir)
    return good.groupBy(run).agg(
        F.max_by(name, "step").alias("latest"), F.max("step").alias("step")
    )


def next_version(history: DataFrame, names: DataFrame, name="name", version="version") -> DataFrame:
    """Latest version per name and the number the next registration gets."""
    latest = history.groupBy(name).agg(F.max(version).alias("latest_version"))
    return (
        names.select(name)
        .distinct()
        .join(latest, name, "left")
        .withColumn("next_version", F.coalesce(F.col("latest_version"), F.lit(0)) + 1)
        .withColumn("uri", model_uri(name, "next_version"))
    )
