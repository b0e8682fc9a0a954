"""Spark sessions, session-bound tasks and the shared scratch folder."""

from __future__ import annotations

import functools
import pathlib
import posixpath
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Mapping

from pyspark.sql import SparkSession

# Session defaults a caller may override.
DEFAULT_SIZES = {
    "spark.executor.instances": "2",
    "spark.executor.memory": "4g",
    "spark.executor.cores": "2",
    "spark.driver.memory": "2g",
    "spark.driver.cores": "1",
    "spark.dynamicAllocation.enabled": "false",
}
DEFAULT_HADOOP = {
    "fs.s3a.impl": "org.apache.hadoop.fs.s3a.S3AFileSystem",
    "fs.s3a.aws.credentials.provider": (
        "com.amazonaws.auth.WebIdentityTokenCredentialsProvider"
    ),
}
# Engine settings every operator here assumes.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",  # long texts: less in a worker at once
}


def session_conf(
    spark_conf: Mapping[str, str] | None = None,
    hadoop_conf: Mapping[str, str] | None = None,
    **sizes: str | int,
) -> dict[str, str]:
    """Merge defaults, size keywords, Hadoop keys and ``spark_conf``; the last wins.

    ``sizes`` are ``executor_instances``, ``executor_memory``, ``executor_cores``,
    ``driver_memory`` and ``driver_cores``.
    """
    conf = {**ENGINE_CONF, **DEFAULT_SIZES}
    for name, value in sizes.items():
        key = "spark." + name.replace("_", ".", 1)
        if key not in DEFAULT_SIZES:
            raise TypeError(f"unknown size setting: {name}")
        conf[key] = str(value)
    for key, value in {**DEFAULT_HADOOP, **(hadoop_conf or {})}.items():
        conf["spark.hadoop." + key] = str(value)
    conf.update({k: str(v) for k, v in (spark_conf or {}).items()})
    return conf


def make_session(
    app_name: str = "corpusflow",
    master: str | None = None,
    spark_conf: Mapping[str, str] | None = None,
    hadoop_conf: Mapping[str, str] | None = None,
    **sizes: str | int,
) -> SparkSession:
    """Build (or reuse) a session from :func:`session_conf`."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in session_conf(spark_conf, hadoop_conf, **sizes).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spark_task(app_name: str = "corpusflow", master: str | None = None, **settings):
    """Decorate ``fn(spark, *args)`` so that callers pass only ``*args``."""

    def decorate(fn: Callable) -> Callable:
        @functools.wraps(fn)
        def run(*args, **kwargs):
            return fn(make_session(app_name, master, **settings), *args, **kwargs)

        return run

    return decorate


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers of a local session, once.

    On a cluster the package is installed or named with ``--py-files``.
    """
    context = spark.sparkContext
    if not context.master.startswith("local") or getattr(context, "_corpusflow_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="corpusflow-")) / "corpusflow.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))
    context._corpusflow_shipped = True


_folders: dict[str, str] = {}


def use_folder(spark: SparkSession, folder: str) -> None:
    """Name the shared folder of a running session that was started without one."""
    _folders[spark.sparkContext.applicationId] = folder


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Where that is unset, the one given to :func:`use_folder`.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or _folders.get(spark.sparkContext.applicationId)
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return named


_scratch: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed by :func:`clear_scratch`."""
    path = posixpath.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Remove what was stored under scratch paths so far; tells how many paths there were.

    Call it when the results that read from them are written.
    """
    paths = _scratch.pop(spark.sparkContext.applicationId, [])
    context = spark.sparkContext
    for path in paths:
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)
