import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import vectors as V

ROWS = "id long, vector array<float>"


def plain_knn(queries, rows, k):
    out = []
    for q, a in queries:
        if a is not None:
            d = sorted((math.dist(a, b), i) for i, b in rows if b is not None)[:k]
            out += [(q, r + 1, i, round(x, 9)) for r, (x, i) in enumerate(d)]
    return sorted(out)


def got(df):
    assert df.columns == ["query", "rank", "id", "distance"]
    return sorted((r.query, r["rank"], r.id, round(r.distance, 9)) for r in df.collect())


@pytest.mark.parametrize("block, portion", [(16_384, 2_048), (16, 5)])
def test_equals_measuring_all_pairs(spark, monkeypatch, block, portion):
    """A crowded place with a third of the rows, far clusters, equal vectors, and few outliers."""
    monkeypatch.setattr(V, "BLOCK_ROWS", block)
    monkeypatch.setattr(V, "PORTION_ROWS", portion)
    rng = random.Random(2)
    centres = [[rng.uniform(-5, 5) for _ in range(6)] for _ in range(8)]
    rows = [(k, [c + rng.gauss(0, 0.3) for c in centres[k % 8]]) for k in range(300)]
    rows += [(1000 + k, [float(x) for x in (1, 2, 3, 0, 0, k % 2)]) for k in range(150)] + [(7000, [50.0] * 6), (7001, None)]
    rows = [(i, None if v is None else [float(int(x * 64)) / 64 for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, ROWS).repartition(4)
    queries = [r for r in rows if r[0] % 7 == 0]
    found = V.knn(df.where("id % 7 = 0"), df, 5, pivots=6)
    assert got(found) == plain_knn(queries, rows, 5)


def test_files_out_of_reach_are_not_read(spark):
    """With clusters far apart the second round has nothing to ask."""
    rows = [(k, [100.0 * (k % 4) + k / 1024, 0.0]) for k in range(80)]
    df = spark.createDataFrame(rows, ROWS)
    assert got(V.knn(df, df, 3, pivots=40)) == plain_knn(rows, rows, 3)
    may = spark.createDataFrame([(10.0, 1.0, 2.0, 3.0), (5.0, 1.0, 2.0, 3.0), (0.5, 4.0, 9.0, 3.0)], "base double, low double, high double, lim double")
    assert [r[0] for r in may.select(V._may_hold("base", "low", "high", "lim")).collect()] == [False, True, False]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.0, 1.0])], [(k, [1.0, 1.0]) for k in range(30)]])
def test_few_and_equal_rows(spark, rows):
    df = spark.createDataFrame(rows, ROWS)
    assert got(V.knn(df, df, 4)) == plain_knn(rows, rows, 4)
    assert V.knn(df.where(F.lit(False)), df, 4).count() == 0


def plain_approx(queries, rows, k, tables, bits, free):
    """The rule by loops: a vector is met if its code agrees in the surest bits of one table."""
    held = [(i, v) for i, v in rows if v is not None]
    middle = [sum(v[d] for _, v in held) / len(held) for d in range(len(held[0][1]))]
    normals = V.planes(tables, bits, len(middle)).tolist()
    sides = lambda v: [sum((x - m) * p for x, m, p in zip(v, middle, n)) for n in normals]
    out = []
    for q, a in queries:
        if a is None:
            continue
        mine, met = sides(a), {}
        for i, b in held:
            other = sides(b)
            for t in range(tables):
                at = range(t * bits, (t + 1) * bits)
                sure = sorted(at, key=lambda x: (abs(mine[x]), x))[free:]
                if all((mine[x] > 0) == (other[x] > 0) for x in sure):
                    met[i] = math.dist(a, b)
        best = sorted((d, i) for i, d in met.items())[:k]
        out += [(q, r + 1, i, round(d, 9)) for r, (d, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block, portion", [(16_384, 2_048), (16, 5)])
@pytest.mark.parametrize("tables, bits, free", [(3, 4, 2), (1, 5, 0), (2, 3, 3)])
def test_approx_equals_its_rule(spark, monkeypatch, block, portion, tables, bits, free):
    """A bucket that holds a third of the rows is cut into blocks; equal vectors, a null one."""
    monkeypatch.setattr(V, "BLOCK_ROWS", block)
    monkeypatch.setattr(V, "PORTION_ROWS", portion)
    rng = random.Random(3)
    rows = [(k, [round(rng.gauss(0, 1), 3) for _ in range(7)]) for k in range(100)]
    rows += [(1000 + k, [2.0, 1.0, 0.5, 0.25, 3.0, 1.0, 4.0]) for k in range(50)] + [(7, None)]
    rows = [(i + 5000 * (v is None), v) for i, v in rows]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(4)
    queries = [r for r in rows if r[0] % 7 == 0]
    found = V.knn_approx(df.where("id % 7 = 0"), df, 5, tables=tables, bits=bits, free=free)
    assert got(found) == plain_approx(queries, rows, 5, tables, bits, free)


def test_approx_recall_and_few_rows(spark):
    rng = random.Random(4)
    rows = [(k, [rng.gauss(k % 6 * 3, 1) for _ in range(16)]) for k in range(400)]
    df = spark.createDataFrame(rows, ROWS)
    per_query = V.recall(V.knn_approx(df, df, 10), V.knn(df, df, 10)).collect()
    assert sum(r.hits for r in per_query) >= 0.9 * sum(r.wanted for r in per_query) == 3600.0
    none = df.where(F.lit(False))
    assert V.knn_approx(none, df, 3).count() == 0 and V.knn_approx(df, none, 3).count() == 0
    assert got(V.knn_approx(df.limit(1), df.limit(1), 3))[0][1:3] == (1, df.first().id)
    with pytest.raises(ValueError):
        V.knn_approx(df, df, 3, bits=2, free=3)


def block_rows(k):
    """In place of the answers: each row of a block under the first query of the portion it met."""

    def answer(queries, block):
        if not queries.num_rows:
            return block.select(["id", "id", "near"]).slice(0, 0).rename_columns(["query", "id", "distance"])
        return pa.table({"query": [queries["id"][0].as_py()] * block.num_rows, "id": block["id"], "distance": block["near"]})

    return answer


def test_blocks_are_copied_for_their_own_queries_only(spark, monkeypatch):
    """Ten queries to each of 20 files, five a portion: two copies of a file, however many files there are."""
    monkeypatch.setattr(V, "PORTION_ROWS", 5)
    monkeypatch.setattr(V, "_answers", block_rows)
    vector = F.array(F.lit(0.0)).alias("vector")
    asks = spark.range(200).select("id", vector, (F.col("id") % 20).cast("int").alias("pivot"), F.lit(0.0).alias("base"), F.lit(1.0).alias("limit"))
    filed = spark.range(400).select("id", vector, (F.col("id") % 20).cast("int").alias("pivot"), F.lit(0.0).alias("near"), F.lit(0).alias("block"))
    blocks = spark.range(20).select(F.col("id").cast("int").alias("pivot"), F.lit(1).alias("blocks"))
    met = V._met(asks, filed, blocks, 1, "query long, id long, distance double")
    assert 400 <= met.count() <= 800 and met.select("id").distinct().count() == 400


@pytest.mark.parametrize("estimates", [1, 50, 4_000_000])
def test_estimates_decide_nothing(spark, monkeypatch, estimates):
    """Vectors far from the origin whose distances are below the rounding of their products; none, too."""
    monkeypatch.setattr(V, "ESTIMATES", estimates)
    rows = [(k, [1e6 + (k * 7 % 64) / 4096, 1e6, 3.0]) for k in range(64)] + [(64 + k, [float("nan"), 0.0, 0.0]) for k in range(2)]
    df = spark.createDataFrame(rows, "id long, vector array<double>").coalesce(1)
    found = V.knn(df.where("id < 64"), df, 7, pivots=3)
    assert got(found) == plain_knn(rows[:64], rows[:64], 7)
