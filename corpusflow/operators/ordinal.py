"""Row positions without a single-partition window.

Rows are cut into buckets by their full sort key, unique tie-break included, so a
key value that holds a third of the table is spread over many buckets like any
other rows. Cut points come from a bounded sample, ranked by Spark, and enter the plan as
literals, whole keys: re-running a lost task always sees the same buckets, and positions
are exact whatever the sample was. Buckets are sized by bytes, as one bucket is one task.
Per-bucket counts (one row per bucket) are the only thing broadcast.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

BUCKET_BYTES = 256 << 20
SAMPLES_PER_BUCKET = 32
SAMPLE_SEED = 42
HASHES_PER_BUCKET = 64

APART = ("_tie", "_more", "_copy")
COPIES = 100_000

# Up to this many rows a sorted limit finds its candidates by itself.
TOP_ROWS = 1_000


def _comparable(df: DataFrame, name: str) -> Column:
    """The key in a form that sorts the same way and survives JSON."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp"))
    if isinstance(dtype, T.DateType):
        return F.unix_date(name)
    if isinstance(dtype, (T.StringType, T.IntegralType)):
        return F.col(name)
    raise TypeError(f"sort key {name}: use text, whole numbers, dates or timestamps")


def _sort_key(df: DataFrame, keys: Sequence[str]) -> Column:
    return F.struct(*[_comparable(df, k).alias(f"k{i}") for i, k in enumerate(keys)])


def _row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes."""
    size = F.lit(8 * len(df.columns)).cast("long")
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType)):
            size = size + 16 * F.greatest(F.size(c), F.lit(0))
    return size


def _measure(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes, in one pass."""
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(_row_bytes(df)), F.lit(0))).first()
    return row[0], row[1]


def _width(df: DataFrame, size: int, buckets: int | None) -> int:
    parallel = df.sparkSession.sparkContext.defaultParallelism
    return max(parallel, math.ceil(size / BUCKET_BYTES)) if buckets is None else buckets


def cut_points(
    df: DataFrame, keys: Sequence[str], buckets: int | None = None, total: int | None = None
) -> list[dict]:
    """About evenly spaced sort keys that occur, ``buckets - 1`` of them at most.

    Draws rows, not keys, so a key that repeats is drawn as often as its share says and no more:
    the sample is about ``SAMPLES_PER_BUCKET`` rows per bucket of any table. It is ranked in one
    task; only the chosen keys reach the driver.
    """
    if total is None or buckets is None:
        total, size = _measure(df)
        buckets = _width(df, size, buckets)
    if total == 0 or buckets < 2:
        return []
    key = df.select(_sort_key(df, keys).alias("key"))
    fields = key.schema["key"].dataType.fields
    wanted = buckets * SAMPLES_PER_BUCKET
    if total > wanted:
        key = key.where(F.rand(SAMPLE_SEED) < F.lit(wanted / total))
    ranked = key.select(
        "key",
        (F.row_number().over(Window.orderBy("key")) - 1).alias("_at"),
        F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("_n"),
    )
    bucket = lambda at: F.floor(at * buckets / F.col("_n"))
    chosen = ranked.where((F.col("_at") > 0) & (bucket(F.col("_at")) > bucket(F.col("_at") - 1)))
    picks = [r["key"].asDict() for r in sorted(chosen.select("_at", "key").collect(), key=lambda r: r["_at"])]
    picks = [p for i, p in enumerate(picks) if i == 0 or p != picks[i - 1]]
    # Leading fields that tell all cuts apart are enough; a hot value needs more of them.
    for width in range(1, len(fields)):
        short = [dict(list(p.items())[:width]) for p in picks]
        if all(a != b for a, b in zip(short, short[1:])):
            return short
    return picks


def _plain(dtype: T.DataType) -> T.DataType:
    """The type without what the schema says about nulls."""
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, f.dataType) for f in dtype])
    return dtype


def with_bucket(
    df: DataFrame, keys: Sequence[str], cuts: list[dict], name: str = "_bucket"
) -> DataFrame:
    """Add the number of cut points at or below the row's key, by binary search."""
    if not cuts:
        return df.withColumn(name, F.lit(0))
    used = keys[: len(cuts[0])]
    key, values = _sort_key(df, used), cuts
    if len(used) == 1 and all(c["k0"] is not None for c in cuts):
        key, values = _comparable(df, used[0]), [c["k0"] for c in cuts]
    dtype = _plain(df.select(key.alias("key")).schema["key"].dataType)
    points = F.from_json(F.lit(json.dumps(values)), T.ArrayType(dtype))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])

    def locate(k):
        def go_on(at, step):
            # Past the end the point is null, and the search stays where it is.
            return F.when(F.get(points, at + step - 1) <= k, at + step).otherwise(at)

        return F.aggregate(steps, F.lit(0), go_on)

    # The one-element transform evaluates the key once per row, not once per step.
    return df.withColumn(name, F.get(F.transform(F.array(key), locate), 0))


def in_buckets(bucketed: DataFrame, cuts: list[dict]) -> DataFrame:
    """Shuffle every bucket to a task of its own.

    Windows and groups that partition by ``_bucket`` first need no further shuffle.
    """
    return bucketed.repartitionById(len(cuts) + 1, F.col("_bucket"))


def same_columns(*names: str) -> list[Column]:
    """Null-safe equality of columns of the sides aliased ``a`` and ``b``.

    Also the way to join on a bucket: plain equality makes the optimizer test the
    column for null at the scan, which runs the search one more time.
    """
    return [F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in names]


def _offsets(counts: DataFrame, bucket: str) -> DataFrame:
    """Rows before each bucket. ``counts`` holds one row per bucket."""
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        bucket, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"), "count"
    )


def global_ordinal(
    df: DataFrame, keys: Sequence[str], name: str = "ord", buckets: int | None = None
) -> DataFrame:
    """Add the dense 0-based position of every row in the order of ``keys``.

    ``keys`` must be unique together. ``df`` is read for the cuts and the counts
    (key columns only) and once more for the result; hand in a stored table rather
    than an expensive plan.
    """
    return _placed(df, keys, name, cut_points(df, keys, buckets))


def _placed(df: DataFrame, keys: Sequence[str], name: str, cuts: list[dict]) -> DataFrame:
    bucketed = with_bucket(df, keys, cuts)
    counts = _offsets(bucketed.groupBy("_bucket").count(), "_bucket").drop("count")
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys))
    ranked = in_buckets(bucketed, cuts).withColumn("_rank", within)
    return (
        ranked.alias("a")
        .join(F.broadcast(counts.alias("b")), same_columns("_bucket"))
        .select(
            *[F.col(f"a.{c}") for c in df.columns],
            (F.col("b._before") + F.col("_rank") - 1).alias(name),
        )
    )


def aligned_ordinal(
    df: DataFrame,
    keys: Sequence[str],
    unit: int,
    name: str = "ord",
    buckets: int | None = None,
) -> DataFrame:
    """As :func:`global_ordinal`, cut only between runs of ``unit`` rows.

    The keys alone are ranked first, which gives the exact key at which every bucket
    begins; whole rows are then shuffled once. The result keeps ``_bucket``: it is
    partitioned by it, and a run never crosses one, so work per run that also partitions
    by ``_bucket`` needs no second shuffle.

    Keys that repeat where a bucket has to begin are told apart by hashes of the whole row,
    and equal rows, which may stand for each other, by their number (:func:`_told_apart`).
    """
    total, size = _measure(df)
    width = _width(df, size, buckets)
    narrow = df.select(*keys)
    step = unit * max(1, math.ceil(total / (unit * width)))
    if APART[0] not in keys and _crowded(narrow, HASHES_PER_BUCKET * width, 2 * step):
        # A bucket begins within the rows of one key anyway; they are not ranked in one task first.
        return aligned_ordinal(_told_apart(df), [*keys, *APART], unit, name, width).drop(*APART)
    ranked = _placed(narrow, keys, "_at", cut_points(narrow, keys, width, total))
    edges = ranked.where(((F.col("_at") % step == 0) & (F.col("_at") > 0)) | (F.col("_at") % step == step - 1))
    found = {r["_at"]: r["key"].asDict() for r in edges.select("_at", _sort_key(edges, keys).alias("key")).collect()}
    begins = [at for at in sorted(found) if at and at % step == 0]
    if any(found[at] == found.get(at - 1) for at in begins):
        apart = aligned_ordinal(_told_apart(df), [*keys, *APART], unit, name, width)
        return apart.drop(*APART)
    cuts = [found[at] for at in begins]
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys))
    position = F.col("_bucket").cast("long") * step + within - 1
    return in_buckets(with_bucket(df, keys, cuts), cuts).withColumn(name, position)


def _crowded(keys: DataFrame, hashes: int, most: int) -> bool:
    """Whether more than ``most`` rows share a hash of ``hashes``: so they do where a key has that many."""
    place = F.pmod(F.xxhash64(*[f"`{c}`" for c in keys.columns]), F.lit(hashes))
    return (keys.groupBy(place.alias("_hash")).count().agg(F.max("count")).first()[0] or 0) > most


def _told_apart(df: DataFrame) -> DataFrame:
    """Add the columns ``APART``, which no two rows have in common: 128 bits of hash and a number
    among equal rows.

    Equal rows are counted, which combines before the shuffle, and then laid out again by
    number, ``COPIES`` in one go, so that a row of which there are very many is no single task.
    """
    names = [f"`{n}`" for n in df.columns]
    plain = [
        F.array_sort(F.map_entries(n)) if isinstance(f.dataType, T.MapType) else F.col(n) for n, f in zip(names, df.schema)
    ]
    # A null says where it stands, so that (null, 1) and (1, null) differ.
    hashed = F.struct(*[F.struct(F.lit(k).alias("at"), c.isNull().alias("none"), c.alias("value")) for k, c in enumerate(plain)])
    tie, more = F.xxhash64(hashed), F.xxhash64(F.lit("more"), hashed)
    counted = df.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    # Few runs make many rows: a number that is given is not made smaller by their size.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = counted.withColumn("_run", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(COPIES))))
    runs = runs.withColumns({"_tie": tie, "_more": more}).repartition(parts, "_tie", "_run")
    last = F.least(F.col("_run") + COPIES, F.col("_n")) - 1
    return runs.withColumn("_copy", F.explode(F.sequence(F.col("_run"), last))).select(*names, *APART)


def group_ordinal(
    df: DataFrame,
    group: Sequence[str],
    keys: Sequence[str],
    name: str = "ord",
    buckets: int | None = None,
) -> DataFrame:
    """Add the dense 0-based position of every row within its group.

    A group larger than a bucket spans several; only the parts after its first need
    an offset, at most one per cut point, so the broadcast stays bounded.
    """
    order = [*group, *keys]
    cuts = cut_points(df, order, buckets)
    bucketed = with_bucket(df, order, cuts)
    part = ["_bucket", *group]
    before = (
        Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        bucketed.groupBy(*part)
        .count()
        .select(*part, F.sum("count").over(before).alias("_before"))
        .where("_before > 0")
    )
    within = F.row_number().over(Window.partitionBy(*part).orderBy(*keys))
    return (
        in_buckets(bucketed, cuts)
        .withColumn("_rank", within)
        .alias("a")
        .join(F.broadcast(carried.alias("b")), same_columns(*part), "left")
        .select(
            *[F.col(f"a.{c}") for c in df.columns],
            (F.coalesce("b._before", F.lit(0)) + F.col("_rank") - 1).alias(name),
        )
    )


def keys_at(
    df: DataFrame, bucket: Column, keys: Sequence[str], positions: Mapping[str, Column]
) -> dict[str, Column]:
    """The sort keys found at some positions, each as a scalar struct; null past the end.

    ``bucket`` must grow with ``keys`` and take a bounded number of values; positions
    may use ``total``, the row count. Only keys are read, and only the buckets that
    hold a position are ranked: callers compare whole rows with the result instead of
    shuffling them. A key that repeats across a position is an error: no bound would
    give exact sizes.
    """
    tagged = df.select(F.struct(*keys).alias("_key"), bucket.alias("_bucket"))
    offsets = _offsets(tagged.groupBy("_bucket").count(), "_bucket").withColumn(
        "total", F.sum("count").over(Window.partitionBy(F.lit(1)))
    )
    asked = F.array(
        *[F.struct(F.lit(n).alias("_name"), p.cast("long").alias("_at")) for n, p in positions.items()]
    )
    wanted = (
        offsets.withColumn("_asked", asked)
        .select("_bucket", "_before", "count", F.inline("_asked"))
        .where("_at >= _before and _at < _before + count")
    )  # one row per position
    place = Window.partitionBy("_name").orderBy("_key")
    rank = F.row_number().over(place)
    repeats = F.raise_error(F.lit("the key repeats where a slice begins: add a column that tells its rows apart"))
    hits = (
        tagged.alias("a")
        .join(F.broadcast(wanted.alias("b")), same_columns("_bucket"))
        .drop("_bucket")
        .withColumns({"_rank": rank, "_first": F.rank().over(place)})
        .where("_before + _rank - 1 = _at")
        .withColumn("_key", F.when(F.col("_first") < F.col("_rank"), repeats).otherwise(F.col("_key")))
    )
    found = hits.agg(
        F.struct(
            *[F.max(F.when(F.col("_name") == n, F.col("_key"))).alias(n) for n in positions]
        ).alias("_found")
    ).scalar()
    return {n: found.getField(n) for n in positions}


def rank_slice(
    df: DataFrame, bucket: Column, keys: Sequence[str], start: Column, stop: Column
) -> DataFrame:
    """Rows whose position lies in ``[start, stop)``; whole rows are not shuffled.

    See :func:`keys_at` for ``bucket`` and the expressions.
    """
    bounds = keys_at(df, bucket, keys, {"start": start, "stop": stop})
    key = F.struct(*keys)
    inside = (key >= bounds["start"]) & F.coalesce(key < bounds["stop"], F.lit(True))
    return df.where(F.coalesce(inside, F.lit(False)))


def head(df: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    """First ``n`` rows, sorted by ``keys``; which of equal keys at the end is left open."""
    return _nearest(df, n, keys, [F.col(k) for k in keys], descending=False)


def tail(df: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    """Last ``n`` rows, the last one first."""
    return _nearest(df, n, keys, [F.col(k).desc() for k in keys], descending=True)


def _nearest(df: DataFrame, n: int, keys: Sequence[str], order: list[Column], descending: bool) -> DataFrame:
    """The sorted limit. For many rows, whole buckets are taken first, so that only what is
    missing from the bucket at the bound meets in one task; the result is the same.
    """
    try:
        _sort_key(df, keys)
    except TypeError:
        return df.orderBy(*order).limit(n)
    if n <= TOP_ROWS:
        return df.orderBy(*order).limit(n)
    bucketed = with_bucket(df, keys, cut_points(df, keys), "_spot")
    counts = sorted(((r["_spot"], r["count"]) for r in bucketed.groupBy("_spot").count().collect()), reverse=descending)
    whole, taken, rest = [], 0, None
    for spot, count in counts:
        if taken + count > n:
            rest = spot
            break
        whole.append(spot)
        taken += count
    if rest is None:
        return df.orderBy(*order)
    inside = F.col("_spot") > rest if descending else F.col("_spot") < rest
    last = bucketed.where(F.col("_spot") == rest).orderBy(*order).limit(n - taken)
    return bucketed.where(inside).union(last).drop("_spot").orderBy(*order)


def tail_where(df: DataFrame, n: Column, keys: Sequence[str]) -> DataFrame:
    """Last ``n`` rows, ``n`` being an expression over ``total``, the row count."""
    start = F.greatest(F.col("total") - n, F.lit(0))
    return _between(df, keys, start, F.col("total"))


def _between(df: DataFrame, keys: Sequence[str], start: Column, stop: Column) -> DataFrame:
    spot = with_bucket(df, keys, cut_points(df, keys), "_spot")
    return rank_slice(spot, F.col("_spot"), keys, start, stop).drop("_spot")


def zip_columns(left: DataFrame, right: DataFrame, ordinal: str = "ord") -> DataFrame:
    """Pair rows by position; stops at the shorter side."""
    return left.join(right, ordinal, "inner")


def sort_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Add ``position``: by the last number in the file name, then by path.

    Text order breaks once shard numbers outgrow their padding; the number does not.
    """
    number = F.regexp_extract(F.substring_index(path, "/", -1), r"(\d+)\D*\z", 1).try_cast("long")
    numbered = files.withColumn("_number", F.coalesce(number, F.lit(-1)))
    return global_ordinal(numbered, ["_number", path], "position").drop("_number")
