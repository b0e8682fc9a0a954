import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusflow.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = set()
    for k in range(len(words) - 4):
        if grams[tuple(words[k : k + 5])] > 1:
            covered |= set(range(k, k + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return n, sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered), failed


def labels_of(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def junk(spark):
    """Documents of which every fifth is junk in one of two ways, with labels for most."""
    rng = random.Random(1)
    rows, pairs = [], []
    for k in range(900):
        words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(rng.randint(20, 60))]
        bad = k % 5 == 0
        if bad and k % 2:
            words = [w + rng.choice(["###", "|", "$$"]) for w in words]
        elif bad:
            words = [w.upper() for w in words]
        rows.append((k, " ".join(words)))
        if k % 7:
            pairs.append((k, int(not bad), 0))
    pairs += [(10_000, 0, 0), (3, None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), labels_of(spark, pairs)


def test_statistics(spark, documents, rows):
    got = quality.quality_digest(documents, labels_of(spark, []))
    told = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.collect())
    assert told == Counter((r[0], *brute(r[1])) for r in rows)
    assert got.filter("kept = base_failed").count() == 0  # no labels, no rules


def test_repeats_of_small_vocabularies(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abc"[: rng.randint(1, 3)], k=rng.randint(0, 40))) for _ in range(150)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality.statistics(df, F.col("text"), "doc_id").collect()}
    assert got == {k: brute(t)[4] for k, t in enumerate(texts)}


def test_rules_are_learned(junk):
    documents, labels = junk
    _, rules = quality.learn_from(documents, labels)
    assert 1 <= len(rules) <= quality.MAX_RULES
    got = quality.quality_digest(documents, labels).collect()
    kept = {r.doc_id for r in got if r.kept}
    assert all(k % 5 for k in kept)  # all junk goes, labelled or not
    assert sum(1 for r in got if r.doc_id % 5 and not r.kept and not r.base_failed) <= 2


def test_rules_are_stable_and_ordered(junk):
    documents, labels = junk
    a, b = (quality.learn_from(d, labels)[1] for d in (documents, documents.repartition(6)))
    assert list(map(str, a)) == list(map(str, b))


def test_stage_keeps_columns(documents, spark):
    kept = quality.keep_good(documents, [])
    assert kept.columns == documents.columns
    told = quality.quality_digest(documents, labels_of(spark, []))
    assert kept.count() == told.filter("kept").count()


def test_bad_labels_only_and_no_rows(spark, documents, nothing):
    assert quality.learn_from(documents, labels_of(spark, [(k, 0, 0) for k in range(30)]))[1] == []
    assert quality.quality_digest(nothing, labels_of(spark, [(1, 1, 0)])).count() == 0


def test_wilson_bound():
    assert quality.wilson(0, 0) == 0 and quality.wilson(5, 5) < quality.wilson(50, 50) < 1


def test_native(junk):
    plan = quality.quality_digest(*junk)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
