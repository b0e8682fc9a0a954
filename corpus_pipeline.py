"""From raw documents to sharded training text: five stages, each a table of the next.

Every stage reads what the one before wrote and returns the columns of ``documents``; the
last adds its shard. Benchmark and labels are read beside the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusflow.llm import decontaminate, mixing, quality, sharding, simhash
from corpusflow.llm.store import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHARDS = 8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or the learned list."""
    _, rules = quality.learn_from(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs.select(*COLUMNS), rules)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return simhash.drop_near_copies(docs.select(*COLUMNS))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that share a span with a benchmark item."""
    marked = decontaminate.mark_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return marked.filter("n_hit = 0").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents, some repeatedly, so that sources meet their target weights."""
    return mixing.mix_documents(docs.select(*COLUMNS))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the shard of each document, now and with one shard more."""
    return sharding.assign_shards(docs.select(*COLUMNS), "doc_id", SHARDS)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Hashes and learned rules decide; SQL cannot express them. Tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
