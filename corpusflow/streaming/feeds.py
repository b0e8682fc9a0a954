"""Stream sources, sinks and the stateless streams."""

from __future__ import annotations

import posixpath
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T

from corpusflow.operators.activity import activity_predicate
from corpusflow.operators.scoring import score_requests


def read_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    format: str = "parquet",
    glob: str | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Feed of the files that appear below ``path``, with a declared schema."""
    reader = spark.readStream.schema(schema).format(format)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def run_available(stream: DataFrame, root: str) -> DataFrame:
    """Process what is there, append it below ``root``, and return the stored rows.

    Offsets and state are kept below ``root`` as well, so a later call goes on where
    this one stopped.
    """
    spark = stream.sparkSession
    out = posixpath.join(root, "rows")
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", posixpath.join(root, "checkpoint"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def activity_stream(samples: DataFrame, output: str = "active", **columns: str) -> DataFrame:
    """Add the activity verdict to every sample."""
    return samples.withColumn(output, activity_predicate(**columns))


def answer_stream(requests: DataFrame, load: Callable) -> DataFrame:
    """Answers to valid requests, as :func:`score_requests` gives them in batch."""
    return score_requests(requests, load)
