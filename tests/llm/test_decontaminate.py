import hashlib
import random
import re

import pytest

from corpusflow.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ITEMS = "item_id long, text string, n_hit string"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(rows, items):
    windows = {}
    for item, text in items:
        words = WORD.findall(low(text))
        n = min(10, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[k : k + n]), set()).add(item)
    out = []
    for row in rows:
        words = WORD.findall(low(row[1]))
        hit, found = [0] * len(words), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    found |= windows[tuple(words[k : k + n])]
                    hit[k : k + n] = [1] * n
        found.discard(None)
        listed = ",".join(sorted(map(str, found)))
        out.append((row[0], len(words), sum(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), sum(hit) > 0))
    return out


def data(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(12)] + ["é", "ünï", "A1"]
    text = lambda n: rng.choice([" ", ", ", "--"]).join(rng.choices(words, k=n))
    items = [(k, text(rng.choice([1, 2, 3, 4, 5, 7, 9, 10, 11, 14, 30]))) for k in range(25)]
    items += [(3, items[3][1]), (None, text(12)), (77, None), (78, ""), (79, "... !"), (80, items[5][1])]
    rows = [(k, text(rng.randint(0, 60))) for k in range(60)]
    for k in range(0, 60, 3):
        part = items[rng.randrange(25)][1]
        rows[k] = (k, rows[k][1] + "\n" + part.upper() + " ! " + text(5))
    return [*rows, (1, rows[1][1]), (None, rows[0][1]), (2, None)], items


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rows, items = data(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = decontaminate.contamination_digest(docs, spark.createDataFrame([(*i, "") for i in items], ITEMS))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows, items), key=key)


def test_blocks_of_the_benchmark(spark, monkeypatch):
    rows, items = data(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(*i, "") for i in items], ITEMS)
    whole = decontaminate.contamination_digest(docs, bench).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 60)
    parts = decontaminate.contamination_digest(docs, bench).collect()
    assert sorted(map(str, whole)) == sorted(map(str, parts))


def test_odd_documents_and_columns(spark, documents, rows):
    items = [(1, rows[27][1][200:420]), (2, "kurz")]
    bench = spark.createDataFrame([(*i, "") for i in items], ITEMS)
    got = decontaminate.contamination_digest(documents, bench).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, items), key=key)
    marked = decontaminate.mark_contaminated(documents, bench)
    assert set(documents.columns) <= set(marked.columns) and marked.count() == len(rows)


def test_no_rows(spark, documents, nothing):
    empty = spark.createDataFrame([], ITEMS)
    assert decontaminate.contamination_digest(nothing, empty).count() == 0
    assert decontaminate.contamination_digest(documents, empty).filter("contaminated").count() == 0
