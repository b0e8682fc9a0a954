"""Nearest neighbours of a set of query vectors: exact by pivots, approximate by hashed signs.

:func:`knn`: every vector is filed under its nearest pivot. By the triangle inequality a vector v of the
file of pivot p is no nearer to a query q than \\|d(q, p) - d(v, p)\\|, and the file as a whole no
nearer than d(q, p) less its radius. Queries first meet the file of their nearest pivot, which
gives each a k-th distance; then only the files that may still hold a nearer vector, and in
them only the vectors that may be one. Files are cut into blocks of bounded size, and the
queries that come to a block into portions, so no task grows with a file; each block answers
with k rows a query.

:func:`knn_approx`: a table of codes holds one bit a plane, the side of the mean a vector lies on.
A query looks in all buckets of a table that agree with it in the planes it lies farthest from.
Full buckets are cut into blocks in the same way, so none is capped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.session import scratch_path

PIVOTS = 32
BLOCK_ROWS = 16_384
PORTION_ROWS = 16_384
ESTIMATES = 4_000_000  # distances that are estimated at once
ROUNDING = 16 * 2.0**-53
SLACK = 1e-9  # keeps rounding from pruning an equal distance
NUMBERS = "array<double>"


def _stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read from there."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """One row a vector; all vectors have one length."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of two matrices, a few rows of ``a`` at a time."""
    step = max(1, 4_000_000 // max(1, b.size))
    parts = [np.sqrt(((a[k : k + step, None, :] - b[None]) ** 2).sum(2)) for k in range(0, len(a), step)]
    return np.concatenate(parts) if parts else np.zeros((0, len(b)))


def choose_pivots(vectors: DataFrame, vector: str, count: int = PIVOTS) -> np.ndarray:
    """``count`` vectors at most, those of the least hashes: a sample of fixed size."""
    rows = vectors.select(vector).orderBy(F.xxhash64(vector), vector).limit(count)
    return np.unique(np.array([r[0] for r in rows.collect()], np.float64), axis=0)


def _to_pivots(pivots: np.ndarray):
    def measure(batches):
        for batch in batches:
            found = _distances(_matrix(batch.column("vector")), pivots)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("vector"), pa.array(list(found), pa.list_(pa.float64()))], ["id", "vector", "far"]
            )

    return measure


def _measured(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Rows with their distance to every pivot and the nearest one."""
    id_type = dict(df.dtypes)["id"]
    far = df.mapInArrow(_to_pivots(pivots), f"id {id_type}, vector {NUMBERS}, far {NUMBERS}")
    nearest = (F.array_position("far", F.array_min("far")) - 1).cast("int")
    return far.withColumn("pivot", nearest)


def _answers(k: int):
    """One portion of queries against one block: each query's k nearest there.

    A matrix product estimates all distances; those that its rounding leaves in doubt are measured.
    """

    def answer(queries: pa.Table, block: pa.Table) -> pa.Table:
        if not queries.num_rows or not block.num_rows:
            return pa.table({"query": queries.column("id")[:0], "id": block.column("id")[:0], "distance": pa.array([], pa.float64())})
        block = block.take(pa.array(np.argsort(block.column("near").to_numpy(), kind="stable")))
        queries = queries.take(pa.array(np.argsort(queries.column("base").to_numpy(), kind="stable")))
        vectors, near, points = _matrix(block.column("vector")), block.column("near").to_numpy(), _matrix(queries.column("vector"))
        base, limits = queries.column("base").to_numpy(), queries.column("limit").to_numpy()
        limits = np.where(np.isnan(limits), np.inf, limits)
        ids, squares = block.column("id").to_pylist(), (vectors**2).sum(1)
        at, rows, distances = [], [], []
        step = max(1, ESTIMATES // len(vectors))
        for start in range(0, len(points), step):
            some, reach = points[start : start + step], limits[start : start + step] + SLACK
            here = base[start : start + step]
            first, last = 0, len(vectors)
            if np.isfinite(reach).all():  # rows are in the order of their distance to the pivot
                first, last = np.searchsorted(near, (here - reach).min(), "left"), np.searchsorted(near, (here + reach).max(), "right")
            if first >= last:
                continue
            own = (some**2).sum(1)
            estimates = own[:, None] + squares[None, first:last] - 2 * (some @ vectors[first:last].T)
            doubt = ROUNDING * (vectors.shape[1] + 8) * (own + squares[first:last].max())
            bound = reach**2 + 2 * doubt
            if last - first > k:
                bound = np.fmin(bound, np.partition(estimates, k - 1, axis=1)[:, k - 1] + 2 * doubt)
            for q, point in enumerate(some):
                may = first + np.flatnonzero(~(estimates[q] > bound[q]))
                d = np.sqrt(((vectors[may] - point) ** 2).sum(1))
                if len(d) > k:  # all of the k-th distance, of which the least ids stay
                    near_by = np.flatnonzero(~(d > np.partition(d, k - 1)[k - 1]))
                    near_by = sorted(near_by, key=lambda i: (np.isnan(d[i]), d[i], ids[may[i]]))[:k]
                    may, d = may[near_by], d[near_by]
                at += [start + q] * len(may)
                rows += list(may)
                distances += list(d)
        found = queries.column("id").take(pa.array(at, pa.int64()))
        return pa.table({"query": found, "id": block.column("id").take(pa.array(rows, pa.int64())), "distance": pa.array(distances, pa.float64())})

    return answer


def _met(asks: DataFrame, filed: DataFrame, blocks: DataFrame, k: int, schema: str) -> DataFrame:
    """Queries (id, vector, pivot, base, limit) against the blocks of their pivots' files.

    A file's queries are cut by their own number, so a block is copied once for each
    ``PORTION_ROWS`` of the queries that come to its file, and a query once for each block.
    """
    coming = asks.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / PORTION_ROWS).cast("int").alias("portions"))
    plan = _stored(blocks.join(coming, "pivot"), "knn-plan")
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    numbered = asks.join(plan, "pivot").select(
        "id", "vector", "pivot", "base", "limit", place("portions").alias("portion"), each("blocks").alias("block")
    )
    held = filed.join(plan, "pivot").select("id", "vector", "pivot", "near", place("blocks").alias("block"), each("portions").alias("share"))
    grouped = numbered.groupBy("pivot", "block", "portion"), held.groupBy("pivot", "block", "share")
    return grouped[0].cogroup(grouped[1]).applyInArrow(_answers(k), schema)


def knn(
    queries: DataFrame, vectors: DataFrame, k: int, query: str = "id", key: str = "id", vector: str = "vector", pivots: int = PIVOTS
) -> DataFrame:
    """``query``, ``rank`` (from 1), ``id``, ``distance``: the k nearest vectors of each query.

    Euclidean distance in doubles; equal distances rank by id. ``query`` and ``key`` do not
    repeat. Rows without a vector are left out. A vector that is a query as well finds itself.
    """

    def rows(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col(vector).isNotNull()).select(F.col(name).alias("id"), F.col(vector).cast(NUMBERS).alias("vector"))

    asked, held = rows(queries, query), rows(vectors, key)
    chosen = choose_pivots(held, "vector", pivots)
    q_type, v_type = dict(asked.dtypes)["id"], dict(held.dtypes)["id"]
    schema = f"query {q_type}, id {v_type}, distance double"
    if not len(chosen):
        return queries.sparkSession.createDataFrame([], f"query {q_type}, rank int, id {v_type}, distance double")
    near = F.get("far", F.col("pivot"))
    filed = _stored(_measured(held, chosen).select("id", "vector", "pivot", near.alias("near")), "knn-files")
    # One row for each pivot at most.
    files = filed.groupBy("pivot").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"), F.min("near").alias("low"), F.max("near").alias("high")
    )
    files = _stored(files, "knn-pivots")
    blocks = files.select("pivot", "blocks")

    first = _stored(_measured(asked, chosen), "knn-queries")
    # Pivots at the same distance may leave one without a file: take the nearest that has one.
    known = F.array(*(F.lit(r.pivot) for r in files.select("pivot").orderBy("pivot").collect()))
    nearest = F.array_min(F.transform(known, lambda p: F.struct(F.get("far", p).alias("d"), p.alias("p"))))
    first = first.withColumn("pivot", nearest["p"])
    asks = first.select("id", "vector", "pivot", F.get("far", F.col("pivot")).alias("base"), F.lit(float("inf")).alias("limit"))
    found = _stored(_met(asks, filed, blocks, k, schema), "knn-first")

    best = _ranked(found, k)
    # The k-th distance, unbounded where there are fewer.
    limits = best.groupBy(F.col("query").alias("id")).agg(
        F.when(F.count(F.lit(1)) == k, F.max("distance")).otherwise(float("inf")).alias("limit")
    )
    left = first.join(limits, "id").select(
        "id", "vector", "limit", F.col("pivot").alias("done"), F.posexplode("far").alias("pivot", "base")
    )
    left = left.join(F.broadcast(files), "pivot").where((F.col("pivot") != F.col("done")) & _may_hold("base", "low", "high", "limit"))
    rest = _stored(left.select("id", "vector", "pivot", "base", "limit"), "knn-rest")
    both = found.unionByName(_met(rest, filed, blocks, k, schema))
    return _ranked(both, k).select("query", "rank", "id", "distance")


def _may_hold(base: str, low: str, high: str, limit: str) -> Column:
    """Whether a file with distances low..high to its pivot may hold a vector within the limit."""
    reach = F.greatest(F.col(base) - F.col(high), F.col(low) - F.col(base))
    return F.isnan(reach) | (reach <= F.col(limit) + SLACK)  # a vector that is no number bounds nothing


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def planes(tables: int, bits: int, width: int) -> np.ndarray:
    """Normals of 1 and -1, by table, bit and dimension: 1 where the MD5 of ``table:bit:dimension`` begins below 8."""

    def side(*at: int) -> int:
        return 1 if hashlib.md5(":".join(map(str, at)).encode()).hexdigest()[0] < "8" else -1

    signs = [[[side(t, b, d) for d in range(width)] for b in range(bits)] for t in range(tables)]
    return np.array(signs, np.float64).reshape(tables * bits, width)


def _coded(normals: np.ndarray, middle: np.ndarray, bits: int, free: int):
    """Codes of each vector, and the codes it looks up: those with any value in its ``free`` least sure bits."""
    weights = 1 << np.arange(bits, dtype=np.int64)
    choices = np.array([[c >> k & 1 for k in range(free)] for c in range(1 << free)], np.int64).reshape(1 << free, free)

    def code(batches):
        for batch in batches:
            sides = (_matrix(batch.column("vector")).reshape(-1, len(middle)) - middle) @ normals.T
            sides = sides.reshape(len(sides), -1, bits)
            base = (sides > 0) @ weights
            loose = weights[np.argsort(np.abs(sides), axis=2, kind="stable")[:, :, :free]]
            probes = (base & ~loose.sum(2))[:, :, None] + loose @ choices.T
            columns = [batch.column("id"), batch.column("vector"), pa.array(list(base), pa.list_(pa.int64()))]
            columns.append(pa.array([list(p) for p in probes], pa.list_(pa.list_(pa.int64()))))
            yield pa.RecordBatch.from_arrays(columns, ["id", "vector", "codes", "probes"])

    return code


def knn_approx(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    query: str = "id",
    key: str = "id",
    vector: str = "vector",
    tables: int = 6,
    bits: int = 5,
    free: int = 3,
) -> DataFrame:
    """``query``, ``rank`` (from 1), ``id``, ``distance``: the k nearest among the vectors met.

    A vector is met if in one of ``tables`` tables its code of ``bits`` bits is that of the query,
    but for the ``free`` bits whose planes the query lies nearest to. Distances are exact and rank
    as in :func:`knn`. A query that meets fewer than k vectors has fewer rows. All vectors have one
    length. More tables or free bits raise recall and work; :func:`recall` measures it.
    """
    if not 0 <= free <= bits <= 30:
        raise ValueError("free must be between 0 and bits, and bits at most 30")

    def rows(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col(vector).isNotNull()).select(F.col(name).alias("id"), F.col(vector).cast(NUMBERS).alias("vector"))

    asked, held = rows(queries, query), rows(vectors, key)
    q_type, v_type = dict(asked.dtypes)["id"], dict(held.dtypes)["id"]
    width = held.agg(F.max(F.size("vector"))).first()[0] or 0
    if not width:
        return queries.sparkSession.createDataFrame([], f"query {q_type}, rank int, id {v_type}, distance double")
    middle = np.array(held.agg(*(F.avg(F.get("vector", F.lit(d))) for d in range(width))).first(), np.float64)
    code = _coded(planes(tables, bits, width), middle, bits, free)
    columns = f"vector {NUMBERS}, codes array<long>, probes array<array<long>>"
    bucket = (F.col("table") * F.lit(1 << bits) + F.col("code")).alias("pivot")
    coded = held.mapInArrow(code, f"id {v_type}, {columns}").select("id", "vector", F.posexplode("codes").alias("table", "code"))
    filed = _stored(coded.select("id", "vector", bucket), "approx-files")
    sizes = filed.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    filed = filed.withColumn("near", F.lit(0.0))

    looked = asked.mapInArrow(code, f"id {q_type}, {columns}").select("id", "vector", F.posexplode("probes").alias("table", "probe"))
    looked = looked.select("id", "vector", "table", F.explode("probe").alias("code"))
    asks = looked.select("id", "vector", bucket, F.lit(0.0).alias("base"), F.lit(float("inf")).alias("limit"))
    met = _met(_stored(asks, "approx-asks"), filed, sizes, k, f"query {q_type}, id {v_type}, distance double")
    once = met.groupBy("query", "id").agg(F.min("distance").alias("distance"))  # met in several tables
    return _ranked(once, k).select("query", "rank", "id", "distance")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``query``, ``wanted``, ``hits``: how many of the exact neighbours of each query were found."""
    hits = found.select("query", "id", F.lit(1).alias("_hit"))
    joined = exact.join(hits, ["query", "id"], "left")
    return joined.groupBy("query").agg(F.count(F.lit(1)).alias("wanted"), F.count("_hit").alias("hits"))
