import hashlib
import math

import pytest

from corpusflow.operators.embedding import embed_text
from corpusflow.operators.vectors import knn


def plain(text, width, buckets, seed):
    digest = lambda s: hashlib.md5(s.encode()).hexdigest()
    side = lambda c: 1 if c < "8" else -1
    words = (text or "").lower().split()
    out = [0] * width
    for g in words + [" ".join(p) for p in zip(words, words[1:])]:
        h = digest(g)
        bucket = int(h[:8], 16) % buckets
        for d in range(width):
            out[d] += side(h[8]) * side(digest(f"{seed}:{bucket}:{d}")[0])
    size = math.sqrt(sum(x * x for x in out))
    return [x / size if size else 0.0 for x in out]


TEXTS = ["a b c", "A  B\nc", "a", "", None, " \t", "a b c d e f g", "the " * 3000 + "end", "é ü 字"]


@pytest.mark.parametrize("width, buckets, seed", [(8, 16, 0), (5, 1000, 7)])
def test_equals_plain_loops(spark, width, buckets, seed):
    df = spark.createDataFrame([(k, t, [1]) for k, t in enumerate(TEXTS)], "doc_id long, text string, vector array<int>")
    found = embed_text(df.repartition(3), "doc_id", width=width, buckets=buckets, seed=seed).collect()
    assert len(found) == len(TEXTS)
    for r in found:
        assert r.vector == pytest.approx(plain(TEXTS[r.doc_id], width, buckets, seed), abs=1e-12)


def test_neighbours_of_embedded_texts(spark):
    """A copy is at distance 0, a near copy nearer than other texts; an empty table gives no rows."""
    texts = ["one two three four five six", "one two three four five six", "one two three four five seven", "red green blue", "up down"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vectors = embed_text(df, "doc_id")
    near = knn(vectors.where("doc_id = 0"), vectors, 3, "doc_id", "doc_id").collect()
    assert [(r.id, r.distance == 0) for r in sorted(near, key=lambda r: r["rank"])] == [(0, True), (1, True), (2, False)]
    assert embed_text(df.where("doc_id < 0"), "doc_id").count() == 0


def test_nothing_is_shuffled(spark):
    """Rows of any size stay where they lie; equal keys are rows of their own."""
    df = spark.createDataFrame([(1, "a b"), (1, "c")], "doc_id long, text string")
    found = embed_text(df, "doc_id", width=4, buckets=16)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r.vector) for r in found.collect()) == sorted(tuple(plain(t, 4, 16, 0)) for t in ("a b", "c"))
