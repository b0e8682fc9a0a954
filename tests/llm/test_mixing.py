import re
from collections import defaultdict

import pytest

from corpusflow.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    """Shares by weight, what is above three times a source's size dealt anew until none is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        rest, w = total - sum(capped.values()), sum(weight[s] for s in free)
        share = {s: rest * weight[s] / w for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def check(rows, got):
    sizes = defaultdict(int)
    kinds = []
    for i, t, _, s, *_ in rows:
        n = len(WORD.findall(t or ""))
        sizes[s] += n
        kinds.append((i, n, s))
    target = targets(sizes)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((i is None, i or 0, n) for i, n, _ in kinds)
    by_size = {(i, n): s for i, n, s in kinds}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        s = by_size[r.doc_id, r.size]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
        epochs = int(target[s] / sizes[s] + 1e-9) if sizes[s] else 0
        assert r.taken in (epochs * r.size, (epochs + 1) * r.size)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] * 1.01 + 1e-6


def test_small(documents, rows):
    check(rows, mixing.mix_digest(documents).collect())


def test_one_hot_source_many_ranges(spark, monkeypatch):
    rows = [(k, "w " * (k % 37), "en", f"s{k % 40 if k % 3 else 0:02}", 1) for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(mixing, "RANGE_ROWS", 50)
    got = mixing.mix_digest(df).collect()
    check(rows, got)
    again = mixing.mix_digest(df.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 10**9)
    assert sorted(map(tuple, mixing.mix_digest(df).collect())) == sorted(map(tuple, got))


def test_targets_with_caps(spark):
    sizes = {"a": 1000, "b": 1, "c": 2, "d": 0, "e": 500, None: 3}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(targets(sizes))


def test_better_documents_come_first(spark):
    good, bad = "plain words in a row " * 4, "## 12 $$ 34 %% 56 && 78 " * 4
    rows = [(k, good if k % 2 else bad, "en", "abc"[k % 3], 1) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mix_digest(df).collect()
    first = [r for r in got if r.doc_id % 3 == 0]
    taken = [sum(r.taken > 0 for r in first if r.doc_id % 2 == side) for side in (0, 1)]
    assert taken[1] > 1.5 * taken[0]


def test_the_mix_repeats_rows(documents, rows):
    copies = mixing.with_copies(sized := mixing.sized_documents(documents, 17), mixing.source_cuts(sized))
    wanted = sum(r["n"] for r in copies.selectExpr("copies AS n").collect() if r["n"])
    mixed = mixing.mix_documents(documents)
    assert mixed.columns == [c for c in documents.columns] and mixed.count() == wanted


def test_no_rows(nothing):
    assert mixing.mix_digest(nothing).count() == 0 and mixing.mix_documents(nothing).count() == 0
