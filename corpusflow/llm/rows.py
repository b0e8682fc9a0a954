"""Keys for document rows, and lists per key that meet the texts again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.store import stored

BROADCAST_ENTRIES = 2_000_000


def numbered(documents: DataFrame) -> DataFrame:
    """``key``, doc_id, text and the number of equal ``rows``.

    Keys are the ids themselves if each stands once, else ranks in the order of id (null
    last) and hash of the text.
    """
    texts = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = texts.select("doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if ids.filter("doc_id IS NULL OR n > 1").isEmpty():
        return texts.select(F.col("doc_id").cast("long").alias("key"), "doc_id", "text", F.lit(1).cast("long").alias("rows"))
    mark = F.xxhash64("text")
    each = texts.groupBy("doc_id", mark.alias("_mark")).agg(F.count(F.lit(1)).alias("rows"), F.first("text").alias("text"))
    each = stored(each, "distinct-rows")
    keyed = number_rows(each.select("doc_id", "_mark"))
    same = F.col("e.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("e._mark") == F.col("k._mark"))
    return each.alias("e").join(keyed.alias("k"), same).select("k.key", "e.doc_id", "e.text", "e.rows")


def number_rows(rows: DataFrame) -> DataFrame:
    """Add ``key``: 0, 1, ... by id (null last) and mark. Ranges of ids are numbered apart."""
    null_last = F.col("doc_id").isNull()
    ranged = rows.repartitionByRange(null_last, "doc_id", "_mark").withColumn("_part", F.spark_partition_id())
    ranged = stored(ranged, "row-ranges")
    inside = Window.partitionBy("_part").orderBy(null_last, "doc_id", "_mark")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = ranged.withColumn("_in", F.row_number().over(inside) - 1).join(sizes, "_part")
    return numbered.select("doc_id", "_mark", (F.col("_before") + F.col("_in")).alias("key"))


def beside(texts: DataFrame, lists: DataFrame, column: str, how: str, most: int | None = None) -> DataFrame:
    """Join lists of a counted size per key: broadcast if they are few (BROADCAST_ENTRIES, or ``most`` if less), else shuffled."""
    entries = lists.agg(F.coalesce(F.sum(F.size(column)), F.lit(0))).first()[0]
    bound = BROADCAST_ENTRIES if most is None else min(BROADCAST_ENTRIES, most)
    return texts.join(F.broadcast(lists) if entries <= bound else lists, "key", how)
