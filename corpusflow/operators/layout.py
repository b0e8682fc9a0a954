"""How rows are laid out over tasks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

SPREAD_ROWS = 50_000  # rows of costly work in one task, about


def spread(df: DataFrame) -> DataFrame:
    """Deal a table of few bytes out to tasks by rows ahead of costly work per row.

    A file with one row group is one task however many cores wait, and narrow rows lie by the
    million in a split. For tables just read, whose rows are counted: what already has half the
    wanted partitions, one a core and one for ``SPREAD_ROWS`` rows, and streams, stay as they are.
    No operator does this by itself, since it changes which rows lie together.
    """
    if df.isStreaming:
        return df
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / SPREAD_ROWS))
    return df.repartition(wanted) if 2 * df.rdd.getNumPartitions() < wanted else df
