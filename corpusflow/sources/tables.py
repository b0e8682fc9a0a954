"""Tables, shards, splits and listings."""

from __future__ import annotations

import posixpath
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from corpusflow.functions.text import last_segment
from corpusflow.operators.ordinal import aligned_ordinal, global_ordinal

EXAMPLES = T.StructType(
    [
        T.StructField("question", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("answer", T.StringType()),
    ]
)
# Fixed value: rows per shard.
SHARD_ROWS = 10_000

FILE_COLUMN, ROW_COLUMN = "_file", "_row"


class SchemaMismatch(ValueError):
    """A stored table lacks a declared column or holds it in another type."""


def check_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the declared columns; fail when one is absent or of another type."""
    found = {f.name: f.dataType for f in df.schema}
    wrong = [
        f"{f.name} {f.dataType.simpleString()} (found {found[f.name].simpleString() if f.name in found else 'none'})"
        for f in schema
        if found.get(f.name) != f.dataType
    ]
    if wrong:
        raise SchemaMismatch(", ".join(wrong))
    return df.select(*schema.names)


def read_examples(
    spark: SparkSession, path: str, format: str = "parquet", schema: T.StructType = EXAMPLES
) -> DataFrame:
    """Read question, context and answer from Parquet (checked) or JSON lines."""
    if format == "parquet":
        return check_schema(spark.read.parquet(path), schema)
    return spark.read.schema(schema).format(format).load(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_shards(
    df: DataFrame, path: str, keys: Sequence[str], size: int = SHARD_ROWS
) -> None:
    """Write runs of ``size`` consecutive rows in the order of ``keys``, one folder each.

    Folders are ``shard_id=0, 1, ...``; the last may be short and an empty table gives
    none. The path is replaced as a whole, so no shard of an earlier, longer table
    stays behind. Buckets are cut between shards, so rows are shuffled once and each
    shard is one file.
    """
    placed = aligned_ordinal(df, keys, size, "_ord").withColumn(
        "shard_id", F.floor(F.col("_ord") / size).cast("long")
    )
    (
        placed.sortWithinPartitions("shard_id", "_ord")
        .drop("_ord", "_bucket")
        .write.mode("overwrite")
        .option("maxRecordsPerFile", 0)
        .partitionBy("shard_id")
        .parquet(path)
    )


def read_shards(
    spark: SparkSession,
    path: str,
    siblings: bool = False,
    ordinal: str | None = "ord",
    schema: T.StructType | None = None,
) -> DataFrame:
    """Read every Parquet file below ``path``, columns matched by name.

    ``ordinal`` numbers the rows: shards in the order of their number, or of their
    path where it holds none, rows as stored. ``siblings`` also reads folders whose
    name merely starts like ``path``. With a ``schema`` no file is opened to plan the scan;
    without one, the footers of all files are read and merged.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    reader = reader.option("mergeSchema", True) if schema is None else reader.schema(schema)
    df = reader.option("pathGlobFilter", "*.parquet").parquet(path + "*" if siblings else path)
    if ordinal is None:
        return df
    number = F.regexp_extract("_metadata.file_path", r"shard(?:_id=|_)(\d+)", 1)
    placed = df.withColumns(
        {
            "_shard": F.coalesce(number.try_cast("long"), F.lit(-1)),
            FILE_COLUMN: F.col("_metadata.file_path"),
            ROW_COLUMN: F.col("_metadata.row_index"),
        }
    )
    order = ["_shard", FILE_COLUMN, ROW_COLUMN]
    return global_ordinal(placed, order, ordinal).drop(*order)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder per split."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def read_split(spark: SparkSession, path: str, name: str, split: str = "split") -> DataFrame:
    """Rows of one split; only its folder is read."""
    return spark.read.parquet(path).where(F.col(split) == name).drop(split)


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Path, base name and length of the files below ``path``; contents are not read."""
    found = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(path)
    )
    return found.select("path", last_segment("path").alias("name"), "length")


def table_path(root: str, name: str) -> str:
    return posixpath.join(root, f"{name}.parquet")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(root, name))
