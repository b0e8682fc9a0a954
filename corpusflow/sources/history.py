"""Run history and reuse of stored step outputs."""

from __future__ import annotations

import hashlib
import json
import posixpath
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusflow.functions.text import _col

KINDS = ("param", "metric", "tag", "text", "table")


def metric_rows(df: DataFrame, run, values: Mapping[str, str], kind: str = "metric", at=None) -> DataFrame:
    """Long rows ``run_id, kind, key, value, logged_at`` from the columns in ``values``.

    ``values`` maps a key to the column that holds its value.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind: {kind}")
    entries = F.array(
        *[
            F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value"))
            for k, c in values.items()
        ]
    )
    logged = F.current_timestamp() if at is None else _col(at).cast("timestamp")
    return df.select(
        _col(run).cast("string").alias("run_id"),
        F.lit(kind).alias("kind"),
        F.inline(entries),
        logged.alias("logged_at"),
    ).select("run_id", "kind", "key", "value", "logged_at")


def table_rows(df: DataFrame, run, name: str, at=None) -> DataFrame:
    """Each row of ``df`` as one JSON value of kind ``table`` under ``name``."""
    packed = df.select(F.to_json(F.struct(*df.columns)).alias("_json"), _col(run).alias("_run"))
    return metric_rows(packed, "_run", {name: "_json"}, "table", at)


def append_metrics(rows: DataFrame, path: str) -> None:
    """Add long rows to the history; earlier ones stay."""
    rows.write.mode("append").partitionBy("kind").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def latest_metrics(history: DataFrame) -> DataFrame:
    """Last logged value per run, kind and key."""
    order = F.struct("logged_at", "value")
    return history.groupBy("run_id", "kind", "key").agg(F.max_by("value", order).alias("value"))


def step_path(root: str, name: str, version: str, inputs: Mapping) -> str:
    """Where the output of a step with this version and these inputs is kept."""
    text = json.dumps([name, version, inputs], sort_keys=True, default=str)
    return posixpath.join(root, name, hashlib.sha256(text.encode()).hexdigest()[:16])


def stored(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` has finished."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(posixpath.join(path, "_SUCCESS"))
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def materialize(
    spark: SparkSession,
    name: str,
    version: str,
    inputs: Mapping,
    build: Callable[[], DataFrame],
    root: str,
) -> DataFrame:
    """The stored output for this version and these inputs; built and stored if absent.

    ``inputs`` names what the output depends on: paths, settings, upstream versions.
    """
    path = step_path(root, name, version, inputs)
    if not stored(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
