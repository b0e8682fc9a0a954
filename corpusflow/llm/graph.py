"""Connected components of a table of links, by alternating stars.

A large star links each larger neighbour of a node to the least node around it, a small star
does so with the smaller neighbours; components stay as they are, and links turn into one
star per component within a number of rounds that grows with the logarithm of the longest
chain. Every round is an aggregate and a join on the node; a node of any number of links is
combined before the shuffle, and its join is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.store import checkpointed, in_tasks


def _spread(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1] or 0


def _large_star(links: DataFrame, tasks: int | None) -> DataFrame:
    both = in_tasks(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), tasks)
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()


def _small_star(links: DataFrame, tasks: int | None) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("_m"))
    moved = links.join(least, "a").filter("b != _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return in_tasks(moved.union(least.select("a", F.col("_m").alias("b"))), tasks).distinct()


def components(links: DataFrame, rows_a_task: int | None = None) -> DataFrame:
    """From links ``a``, ``b`` (any order, loops ignored) to ``node``, ``root``: the least node.

    Nodes without links and roots themselves are not listed. With ``rows_a_task`` the links are
    counted, and no more tasks take part in a round than they fill; a single one needs no shuffle.
    """

    def tasks(rows: int) -> int | None:
        return None if rows_a_task is None else max(1, -(-rows // rows_a_task))

    links = links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = checkpointed((links if rows_a_task is None else in_tasks(links, tasks(links.count()))).distinct())
    was = _spread(links)
    while was[0]:
        few = tasks(2 * was[0])  # each link is met from both ends
        links = checkpointed(_small_star(_large_star(in_tasks(links, few), few), few))
        now = _spread(links)
        if now == was:
            break
        was = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
