"""Tables and shares of the work that several steps read again."""

from __future__ import annotations

import ctypes
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.session import scratch_path, shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Spark removes the shuffle files of a query when the query has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there.

    The files cut the lineage: a lost executor costs the tasks it ran, not the steps before.
    What was shuffled on the way goes at once, not when the driver collects its garbage.
    """
    path, conf = scratch_path(df.sparkSession, label), df.sparkSession.conf
    was = conf.get(SHUFFLE_CLEANUP, None)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(SHUFFLE_CLEANUP) if was is None else conf.set(SHUFFLE_CLEANUP, was)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove the files of a :func:`stored` table that nothing will read again."""
    context = df.sparkSession.sparkContext
    for folder in {posixpath.dirname(path) for path in df.inputFiles()}:
        place = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(folder))
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def released() -> None:
    """Give memory that a Python worker holds but does not use back to the machine.

    Workers outlive their tasks, and what earlier ones left behind would stand beside the next.
    """
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim is not None:
        trim(0)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` as files of the shared folder that go when nothing refers to them any more."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def join_few(df: DataFrame, few: DataFrame, on: list[str], rows: int, bound: int, how="left"):
    """Join with a table of counted size: broadcast up to ``bound`` rows, else shuffled."""
    return df.join(F.broadcast(few) if rows <= bound else few, on, how)


def in_tasks(df: DataFrame, tasks: int | None) -> DataFrame:
    """``df`` in at most ``tasks`` partitions, where a number is given."""
    return df if tasks is None else df.coalesce(tasks)


def let(value, body):
    """``body(value)`` with ``value`` computed once per row, also where body uses it in loops.

    A lambda that names an outer expression may compute it anew for each element; a lambda
    variable is bound to its value.
    """
    return F.transform(F.array(value), body)[0]
