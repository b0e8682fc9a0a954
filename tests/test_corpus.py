import random
import time

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import corpus as C

TEXTS = [(1, "a b c d e f g"), (2, " \n"), (3, None), (4, "one"), (5, "Hi there. Fine! Ok?no.  End")]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def test_chunks_overlap_and_cover(texts):
    got = [(r.doc_id, r.chunk, r.chunk_text) for r in C.chunk_text(texts, 3, 1).collect()]
    assert [g for g in got if g[0] == 1] == [(1, 0, "a b c"), (1, 1, "c d e"), (1, 2, "e f g")]
    assert [g for g in got if g[0] in (2, 3, 4)] == [(4, 0, "one")]
    with pytest.raises(ValueError):
        C.chunk_text(texts, 3, 3)


def test_sentences(texts):
    got = [(r.position, r.sentence) for r in C.split_sentences(texts).where("doc_id = 5").collect()]
    assert got == [(0, "Hi there."), (1, "Fine!"), (2, "Ok?no."), (3, "End")]


def test_token_stats(texts):
    row = C.token_stats(texts, []).first()
    assert tuple(row) == (5, 13, 0, 2.6, 7)


def test_classification_metrics(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), (None, "a"), ("a", None), ("a", "d")]
    got = {r.label: tuple(r)[1:] for r in C.classification_metrics(spark.createDataFrame(pairs, "g string, p string"), "g", "p").collect()}
    assert got["a"] == (0.5, pytest.approx(1 / 3), pytest.approx(0.4), 3)
    assert got["b"] == (0.5, 1.0, pytest.approx(2 / 3), 1)
    assert got["c"] == (0.0, 0.0, 0.0, 1) and got["d"] == (0.0, 0.0, 0.0, 0)


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5), (3.0, 5), (None, 5)], "x double, y int")
    assert [tuple(r) for r in C.min_max(df, ["x", "y"]).collect()] == [(0.0, 0.0), (1.0, 0.0), (None, 0.0)]
    assert [r.x for r in C.standardize(df, ["x"]).collect()] == [-1.0, 1.0, None]


def test_rouge(spark):
    rows = [(1, "The cat sat the", "the cat ran"), (2, "", "x"), (3, None, None), (4, "a", "a")]
    df = spark.createDataFrame(rows, "k int, c string, r string")
    got = {r.k: tuple(r)[1:] for r in C.rouge(df, "k", "c", "r").collect()}
    assert got == {1: (0.5, pytest.approx(2 / 3), pytest.approx(4 / 7)), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0), 4: (1.0, 1.0, 1.0)}
    two = {r.k: tuple(r)[1:] for r in C.rouge(df, "k", "c", "r", 2).collect()}
    assert two[1] == (pytest.approx(1 / 3), 0.5, pytest.approx(0.4)) and two[4] == (0.0, 0.0, 0.0)


def test_rouge_of_long_texts(spark):
    """The work is linear: 100,000 words take seconds, not one pass over the text for each of them."""
    words = [f"w{k % 977}" for k in range(100_000)]
    df = spark.createDataFrame([(1, " ".join(words), " ".join(words[:50_000]))], "k int, c string, r string")
    began = time.monotonic()
    assert C.rouge(df, "k", "c", "r").first() == (1, 0.5, 1.0, pytest.approx(2 / 3))
    assert C.rouge(df, "k", "c", "r", 2).first() == (1, pytest.approx(49_999 / 99_999), 1.0, pytest.approx(2 * 49_999 / 149_998))
    assert time.monotonic() - began < 30


def test_no_rows(spark, texts):
    none = texts.where(F.lit(False))
    assert C.chunk_text(none, 3).count() == C.split_sentences(none).count() == 0
    assert C.rouge(none.withColumn("r", F.lit("x")), "doc_id", "text", "r").count() == 0


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


@pytest.mark.parametrize("block", [3, 64, 4096])
def test_common_subsequence_equals_the_table(monkeypatch, block):
    monkeypatch.setattr(C, "LCS_BLOCK", block)
    rng = random.Random(1)
    for _ in range(60):
        a, b = (rng.choices("abcde"[: rng.randint(1, 5)], k=rng.randint(0, 90)) for _ in range(2))
        assert C.common_subsequence(a, b) == plain_lcs(a, b)


def test_rouge_l(spark):
    rows = [(1, "The cat sat on it", "the cat lay on"), (2, "", "x"), (3, None, None), (4, "a\nb", "A b"), (5, "b a", "a b")]
    rows += [(6, "x " * 5000 + "y", "x " * 5000), (6, "y", "y")]
    got = sorted(map(tuple, C.rouge_l(spark.createDataFrame(rows, "k int, c string, r string"), "k", "c", "r").collect()))
    assert got[:5] == [(1, 0.6, 0.75, pytest.approx(2 / 3)), (2, 0.0, 0.0, 0.0), (3, 0.0, 0.0, 0.0), (4, 1.0, 1.0, 1.0), (5, 0.5, 0.5, 0.5)]
    assert got[5][1:] == (pytest.approx(5000 / 5001), 1.0, pytest.approx(10000 / 10001)) and got[6][1:] == (1.0, 1.0, 1.0)


def test_vocabulary(spark, texts):
    hot = spark.createDataFrame([(9, "the " * 500 + "End one one")], texts.schema).union(texts)
    vocab = [tuple(r) for r in C.build_vocab(hot, 4).orderBy("id").collect()]
    assert vocab == [("the", 2, 500), ("one", 3, 3), ("End", 4, 2), ("Fine!", 5, 1)]
    encode = C.vocab_encoder(C.build_vocab(hot, 4))()
    assert encode(["one  the x\nEnd", ""]) == [[3, 2, 1, 4], []]
    assert C.build_vocab(texts.where("doc_id = 3"), 4).count() == 0
