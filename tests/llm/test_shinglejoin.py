import random

import pytest

from corpusflow.llm import graph, wordbytes
from corpusflow.llm import shinglejoin as J
from llm.conftest import DOCUMENTS, prose


def plain_sets(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        grams = [b" ".join(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [b" ".join(w)] if w else []
        sets.append(set(grams))
    return sets


def plain_components(rows):
    """(doc_id, n, component) by comparing all pairs."""
    sets = plain_sets([r[1] for r in rows])
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), r[0]), r[0])
    out = [(r[0], len(sets[k]), least.get(find(k)) if sets[k] else r[0]) for k, r in enumerate(rows)]
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted(map(tuple, df.collect()), key=repr)


def test_equals_all_pairs(documents, rows):
    assert got(J.near_documents(documents)) == plain_components(rows)


@pytest.mark.parametrize("bucket", [50, 2_000_000])
def test_chains_groups_and_shared_passages(spark, monkeypatch, bucket):
    """Chains of drifting copies, a large group, frequent passages, and pairs at the threshold."""
    monkeypatch.setattr(J, "BUCKET_TOKENS", bucket)
    rng = random.Random(6)
    passage, base = prose(rng, 60), prose(rng, 80).split()
    texts, drift = [], list(base)
    for k in range(40):  # each is near to the one before it only
        drift[rng.randrange(80)] = f"w{k}"
        texts.append(" ".join(drift))
    for _ in range(60):  # near copies of one text
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(80)] = prose(rng, 1)
        texts.append(" ".join(copy))
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 5)}" for _ in range(40)]
    texts += [passage + " " + prose(rng, n) for n in range(12, 18) for _ in range(4)]
    texts += ["a b c", "A  B\nC", "a b c d", "a", "", None]
    rng.shuffle(texts)
    rows = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(J.near_documents(df)) == plain_components(rows)


def test_long_texts_have_the_same_set(monkeypatch):
    rng = random.Random(7)
    texts = [prose(rng, 300).upper().encode(), b"x " * 900 + b"y", b"word", b"\n", (b"z" * 700) + b" end"]
    want = [len(s) for s in plain_sets([t.decode() for t in texts])]
    whole = J.shingle_sets(texts)
    monkeypatch.setattr(J, "PIECE_BYTES", 64)
    cut = J.shingle_sets(texts)
    assert [len(s) for s in whole] == [len(s) for s in cut] == want
    assert all((a == b).all() for a, b in zip(whole, cut))


def test_the_first_filter_keeps_what_can_have_a_partner(spark, monkeypatch):
    rng = random.Random(8)
    shared = prose(rng, 90)
    rows = [(0, shared), (1, shared + " more"), (2, prose(rng, 90)), (3, shared + " " + prose(rng, 90)), (4, shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    described = df.mapInArrow(J._described, "doc_id long, n long, cls binary, batch long, place int, local long")
    kept = J.possible(df, described).collect()
    assert {0, 1, 4} <= {r.doc_id for r in kept} <= {0, 1, 3, 4}
    monkeypatch.setattr(wordbytes, "PORTION_BYTES", 1)  # batches of one row: counts no longer match
    assert {r.doc_id for r in J.possible(df, spark.createDataFrame(described.collect(), described.schema)).collect()} >= {0, 1, 4}


@pytest.mark.parametrize("rows", [[], [(None, None)], [(3, "one two three"), (None, "one two three"), (3, "one two three")]])
def test_few_rows(spark, rows):
    df = spark.createDataFrame(rows, DOCUMENTS.split(", lang")[0])
    assert got(J.near_documents(df)) == plain_components(rows)


@pytest.mark.parametrize("rows_a_task", [None, 3, 1_000_000])
def test_components_in_any_number_of_tasks(spark, rows_a_task):
    """A chain, a star and a repeated link; few links are joined in one task, without a shuffle."""
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 120)] + [(7, 8), (5, 5), (300, 200)]
    df = spark.createDataFrame(links, "a long, b long").repartition(6)
    found = {r.node: r.root for r in graph.components(df, rows_a_task).collect()}
    assert found == {**{k: 0 for k in range(1, 41)}, **{k: 100 for k in range(101, 120)}, 300: 200}
    assert graph.components(df.filter("a < 0"), rows_a_task).count() == 0
