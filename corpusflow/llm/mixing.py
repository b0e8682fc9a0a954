"""Mixing sources to target weights by weighted sampling without replacement.

Every document draws an exponential key, ``-ln(u) / quality`` (Efraimidis and Spirakis):
the smallest keys are a sample in which better documents come first more often. ``u`` is a
hash of id and text, so reruns agree. A source takes complete epochs as long as they fit its
target and then, in key order, documents up to the rest of the target: the one that crosses
the rest is taken if that comes nearer.

No source is sorted as a whole. Keys are cut into ranges, the sizes are summed by range, and
only the range in which the target is crossed is sorted, so a source may hold any share of
the table. The text is never shuffled.

Rows: a null or blank text has size 0 and is taken in complete epochs only (taken 0 words).
Null is a source of its own, the last. Equal rows have equal keys and are taken or left
together. An empty table gives no rows. Other columns are kept; names that begin with
``_mix`` are used inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.store import join_few, stored

WORDS = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
MAX_EPOCHS = 3
RANGE_ROWS = 20_000
BROADCAST_SOURCES = 20_000
LEAST_QUALITY = 0.1


def size_in_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def quality_weight(text: Column) -> Column:
    """From 0.1 to 1: the share of characters that are not symbols, digits or spaces."""
    whole = F.coalesce(text, F.lit(""))
    letters = F.length(F.translate(whole, SPACES + "0123456789#*$%&|<>{}[]\\/=_+~^@", ""))
    share = letters / F.greatest(F.length(whole), F.lit(1))
    return F.lit(LEAST_QUALITY) + (1 - LEAST_QUALITY) * share


def sampling_key(quality: Column, seed: int, *identity: Column) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *identity), 11) + 0.5) / 2.0**53
    return -F.ln(u) / quality


def source_targets(sizes: DataFrame) -> DataFrame:
    """Targets of the sources, from one row per source with its ``source_size``.

    Sources weigh 1, 2, 3, repeating, in order of code points, null last. A target is its
    share of all sizes or 3 times its source's size, whichever is less; what the others
    leave is shared anew by weight. That is one water level: in order of size per weight,
    the capped sources are the first ones, and the level follows from running sums. The
    windows see one row per source.
    """
    place = Window.orderBy(F.col("source").isNull(), "source")
    weighed = sizes.withColumn("_mix_w", ((F.row_number().over(place) - 1) % 3 + 1).cast("double"))
    weighed = weighed.withColumn("_mix_cap", MAX_EPOCHS * F.col("source_size").cast("double"))
    everything = Window.partitionBy(F.lit(0))
    order = Window.orderBy(F.col("_mix_cap") / F.col("_mix_w"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total, weights = F.sum("source_size").over(everything), F.sum("_mix_w").over(everything)
    level = (total - F.coalesce(F.sum("_mix_cap").over(before), F.lit(0.0))) / (
        weights - F.coalesce(F.sum("_mix_w").over(before), F.lit(0.0))
    )
    leveled = weighed.withColumn("_mix_level", level)
    # A source is capped if it cannot hold the level at its place; so is every one before it.
    full = F.col("_mix_level") * F.col("_mix_w") >= F.col("_mix_cap")
    free = F.min(F.when(~full, F.struct(F.col("_mix_cap") / F.col("_mix_w"), F.col("_mix_level")))).over(everything)
    target = F.when(full, F.col("_mix_cap")).otherwise(free.getField("_mix_level") * F.col("_mix_w"))
    return leveled.select("source", "source_size", target.alias("target"))


def sized_documents(documents: DataFrame, seed: int) -> DataFrame:
    """``documents`` with the size, sampling key and identity of each row."""
    text = F.col("text").cast("string")
    identity = (F.col("doc_id"), text)
    return documents.withColumns(
        {
            "_mix_size": size_in_words(text),
            "_mix_key": sampling_key(quality_weight(text), seed, *identity),
            "_mix_id": F.xxhash64(F.lit(~seed), *identity),
        }
    )


def source_cuts(sized: DataFrame) -> DataFrame:
    """Per source: target, complete epochs and the last key that the rest takes (or null).

    ``sized`` has source, _mix_size, _mix_key and _mix_id, and is read three times.
    """
    ranges = max(1, sized.count() // RANGE_ROWS)
    sized = sized.withColumn("_mix_range", F.floor((1 - F.exp(-F.col("_mix_key"))) * ranges))
    by_range = sized.groupBy("source", "_mix_range").agg(F.sum("_mix_size").alias("_mix_sum"))
    by_range = stored(by_range, "mix-ranges")
    targets = source_targets(by_range.groupBy("source").agg(F.sum("_mix_sum").alias("source_size")))
    share = F.col("target") / F.col("source_size")
    epochs = F.when(F.col("source_size") > 0, F.floor(share + 1e-9)).otherwise(0).cast("int")
    targets = targets.withColumn("epochs", epochs)
    rest = F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size"))
    targets = stored(targets.withColumn("_mix_rest", rest), "mix-targets")

    same = F.col("s.source").eqNullSafe(F.col("t.source"))
    running = Window.partitionBy("s.source").orderBy("_mix_range").rowsBetween(Window.unboundedPreceding, -1)
    crossing = (
        by_range.alias("s")
        .join(F.broadcast(targets.alias("t")) if targets.count() <= BROADCAST_SOURCES else targets.alias("t"), same)
        .select("s.source", "_mix_range", "_mix_sum", "_mix_rest", F.coalesce(F.sum("_mix_sum").over(running), F.lit(0)).alias("_mix_before"))
        .filter((F.col("_mix_before") < F.col("_mix_rest")) & (F.col("_mix_before") + F.col("_mix_sum") >= F.col("_mix_rest")))
        .groupBy("source")
        .agg(F.min_by(F.struct("_mix_range", "_mix_before", "_mix_rest"), "_mix_range").alias("_mix_at"))
        .select("source", "_mix_at.*")
    )
    units = sized.groupBy("source", "_mix_range", "_mix_key", "_mix_id").agg(F.sum("_mix_size").alias("_mix_size"))
    inside = (
        units.alias("u")
        .join(crossing.alias("c"), F.col("u.source").eqNullSafe(F.col("c.source")) & (F.col("u._mix_range") == F.col("c._mix_range")))
        .select("u.source", "_mix_key", "_mix_id", "_mix_size", "_mix_before", "_mix_rest", F.col("u._mix_range").alias("_mix_range"))
    )
    so_far = Window.partitionBy("source").orderBy("_mix_key", "_mix_id")
    reached = F.sum("_mix_size").over(so_far) - F.col("_mix_size") / 2 + F.col("_mix_before")
    last = (
        inside.withColumn("_mix_in", reached <= F.col("_mix_rest"))
        .groupBy("source")
        .agg(
            F.min("_mix_range").alias("_mix_range"),
            F.max(F.when(F.col("_mix_in"), F.struct("_mix_key", "_mix_id"))).alias("_mix_last"),
        )
    )
    return (
        targets.alias("t")
        .join(last.alias("l"), F.col("t.source").eqNullSafe(F.col("l.source")), "left")
        .select(
            F.col("t.source").alias("_mix_source"),
            "source_size",
            "target",
            "epochs",
            "_mix_range",
            "_mix_last",
            F.lit(ranges).alias("_mix_ranges"),
        )
    )


def with_copies(sized: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add source_size, target and ``copies``, how often the mix takes the row."""
    cuts = stored(cuts, "mix-cuts")
    joined = join_few(
        sized.withColumn("_mix_null", F.col("source").isNull()).withColumn("_mix_source", F.coalesce("source", F.lit(""))),
        cuts.withColumn("_mix_null", F.col("_mix_source").isNull()).withColumn("_mix_source", F.coalesce("_mix_source", F.lit(""))),
        ["_mix_null", "_mix_source"],
        cuts.count(),
        BROADCAST_SOURCES,
        "inner",
    )
    at = F.floor((1 - F.exp(-F.col("_mix_key"))) * F.col("_mix_ranges"))
    key, end = F.col("_mix_key"), F.col("_mix_last._mix_key")
    inside = (key < end) | ((key == end) & (F.col("_mix_id") <= F.col("_mix_last._mix_id")))
    extra = F.when(at < F.col("_mix_range"), 1).when((at == F.col("_mix_range")) & inside, 1).otherwise(0)
    return joined.withColumn("copies", F.col("epochs") + extra)


def mix_documents(documents: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: each row as often as it is taken, with its own columns."""
    sized = sized_documents(documents, seed)
    cuts = source_cuts(stored(sized.select("source", "_mix_size", "_mix_key", "_mix_id"), "mix-sizes"))
    again = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_mix_copy")
    taken = with_copies(sized, cuts).filter("copies > 0")
    return taken.select(*documents.columns, again).drop("_mix_copy")


def mix_digest(documents: DataFrame, seed: int = 17) -> DataFrame:
    """Per document: its size, its source's size and target, and the words the mix takes."""
    sized = stored(
        sized_documents(documents, seed).select("doc_id", "source", "_mix_size", "_mix_key", "_mix_id"), "mix-sizes"
    )
    taken = (F.col("_mix_size") * F.col("copies")).cast("long")
    return with_copies(sized, source_cuts(sized)).select(
        "doc_id", F.col("_mix_size").alias("size"), "source_size", "target", taken.alias("taken"), "copies"
    )
