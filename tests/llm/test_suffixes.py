import hashlib
import random

import numpy as np
import pytest

from corpusflow.llm import induced, suffixes

ROWS = "doc_id long, text string"


def brute(rows, span=100):
    """Digest by trying each string in the order of documents and starts."""
    order = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows})
    seen, found = set(), {}
    for null, i, text in order:
        data = text.encode()
        gone = [False] * len(data)
        for s in range(len(data) - span + 1):
            w = data[s : s + span]
            if w in seen:
                gone[s : s + span] = [True] * span
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        found[None if null else i, text] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return sorted(((r[0], *found[r[0], r[1] or ""]) for r in rows), key=str)


def digest(df):
    return sorted(map(tuple, suffixes.suffix_digest(df).collect()), key=str)


def some_rows(seed, n=60):
    rng = random.Random(seed)
    letters = "abcdefghij klmn"
    passages = ["".join(rng.choices(letters, k=rng.randint(90, 260))) for _ in range(8)]
    rows = []
    for k in range(n):
        text = "".join(rng.choices(letters, k=rng.randint(0, 150)))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 40)
            text += p[a : a + rng.randint(60, 260)] + "".join(rng.choices("xyz", k=rng.randint(0, 4)))
        rows.append((k, text))
    rows[4] = (4, "for " * 150)
    rows[9] = (9, "for " * 90 + "aé" * 80)
    rows[12] = (12, "a" * 99)
    rows[13] = (13, "a" * 101)
    rows[14] = (14, None)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rows = some_rows(seed)
    assert digest(spark.createDataFrame(rows, ROWS).repartition(5)) == brute(rows)


def test_small_shards_and_spilled_queues(spark, monkeypatch):
    rows = some_rows(7)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 500)
    keys, firsts = np.array([r[0] for r in rows if r[1] and len(r[1]) >= 100]), None
    texts = [r[1].encode() for r in rows if r[1] and len(r[1]) >= 100]
    keys, firsts = keys[: len(texts)], np.zeros(len(texts), np.int64)
    whole = suffixes.repeats_among(keys, firsts, texts)
    monkeypatch.setattr(induced, "BLOCK_TUPLES", 16)
    order = induced.suffix_ranks
    monkeypatch.setattr(induced, "suffix_ranks", lambda text, wanted=None, limit=0: order(text, wanted, 100))
    spilled = suffixes.repeats_among(keys, firsts, texts)
    assert all((a == b).all() for a, b in zip(whole, spilled))
    assert digest(spark.createDataFrame(rows, ROWS)) == brute(rows)


def test_large_owners_are_no_shard(spark, monkeypatch):
    """One passage with many surroundings: no task gets more of an owner than a shard's bytes."""
    rng = random.Random(17)
    letters = "abcdefghij klmn"
    passage = "".join(rng.choices(letters, k=180))
    around = lambda: "".join(rng.choices(letters, k=rng.randint(20, 130)))
    rows = [(k, around() + (passage if k % 3 else passage[: 90 + k]) + around()) for k in range(80)] + [(80, "ab" * 300)]
    stored, lists = suffixes.stored, {}

    def told(df, label):
        lists[label] = stored(df, label)
        return lists[label]

    monkeypatch.setattr(suffixes, "stored", told)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 3000)
    assert digest(spark.createDataFrame(rows, ROWS).repartition(6)) == brute(rows)
    runs = lists["suffix-lists"].selectExpr("inline(runs)").groupBy("owner").agg({"*": "count"}).collect()
    assert all(n * (suffixes.SPAN + 1) <= 3000 for _, n in runs)
    assert lists["large-owners"].count() > 0


def test_repeated_and_missing_ids(spark):
    rows = some_rows(11, 30)
    rows += [(3, rows[5][1]), (3, rows[3][1]), (None, rows[6][1]), (None, None), (2, rows[2][1])]
    assert digest(spark.createDataFrame(rows, ROWS).repartition(3)) == brute(rows)


def test_shuffled_lists(spark, monkeypatch):
    from corpusflow.llm import rows as shared

    rows = some_rows(13)
    monkeypatch.setattr(shared, "BROADCAST_ENTRIES", 0)
    assert digest(spark.createDataFrame(rows, ROWS)) == brute(rows)


def test_odd_documents(documents, rows):
    got = sorted(map(tuple, suffixes.suffix_digest(documents).collect()), key=str)
    assert got == brute([r[:2] for r in rows])


def test_no_rows(nothing):
    assert suffixes.suffix_digest(nothing).count() == 0


@pytest.mark.parametrize("limit", [3, 50, 10**6])
def test_suffix_ranks(limit, monkeypatch):
    monkeypatch.setattr(induced, "BLOCK_TUPLES", 4)
    rng = np.random.default_rng(limit)
    for _ in range(150):
        text = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(0, 60)), 0)
        order = sorted(range(len(text)), key=lambda i: list(text[i:]))
        assert list(np.argsort(induced.suffix_ranks(text, None, limit))) == order


def test_queue_gives_tuples_in_order(monkeypatch):
    monkeypatch.setattr(induced, "BLOCK_TUPLES", 5)
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 9, (3, 400))
    queue = induced.DiskQueue(3, 37)
    for a in range(0, 400, 20):
        queue.push(*rows[:, a : a + 20])
    assert len(queue.runs) > 5
    got = np.concatenate(list(queue.pop_all()), axis=1)
    assert (got == rows[:, np.lexsort(rows[::-1])]).all()
