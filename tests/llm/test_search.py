import math
import random
import re
from collections import Counter

import pytest

from corpusflow.llm import search as S
from llm.conftest import prose


def plain_terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return Counter(re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low))


def plain_search(docs, items, k=10):
    """(item, rank, doc, score) by scoring all documents."""
    terms = [plain_terms(t) for _, t in docs]
    held = [c for c in terms if c]
    total, length = len(held), sum(c.total() for c in held)
    df = Counter(t for c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for (doc, _), c in zip(docs, terms):
            if c:
                m = 25 + (75 * c.total() * total) // length
                s = 0
                for t, times in plain_terms(text).items():
                    if t in c:
                        w = math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                        s += times * w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                if s > 0:
                    scores.append((-s, doc is None, doc))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=repr)


def items_of(rng, texts):
    items = [(k, " ".join(rng.sample((t or "x").split() or ["x"], min(6, len((t or "x").split() or ["x"]))))) for k, t in enumerate(texts)]
    return [*items, (90, ""), (91, None), (92, "nowhere-to-be-found"), (93, "Ünïcode é 字 42"), (93, "Ünïcode é 字 42"), (None, items[0][1] * 2)]


@pytest.mark.parametrize("width, block", [(4096, 1 << 20), (16, 200)])
def test_equals_scoring_all(spark, documents, rows, monkeypatch, width, block):
    """Also with sketches so narrow that bounds are loose, and several blocks."""
    rng = random.Random(9)
    items = items_of(rng, [r[1] for r in rows])
    monkeypatch.setattr(S, "BLOCK_BYTES", block if block > 1000 else 1500)
    if width != S.WIDTH:
        monkeypatch.setattr(S, "ROUNDS", (1,))
    queries = spark.createDataFrame([(*i, "a", 1) for i in items], "item_id long, text string, rank string, score int")
    assert got(S.search(S.Index(documents), queries)) == plain_search([r[:2] for r in rows], items)


def test_ties_and_fewer_than_k(spark):
    docs = [(k, "same words here") for k in range(30)] + [(40, "other words"), (41, "HERE'S one"), (None, "same words here")]
    items = [(1, "same here"), (2, "one"), (3, "words words")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    queries = spark.createDataFrame(items, "item_id long, text string")
    assert got(S.search(S.Index(df), queries)) == plain_search(docs, items)
    assert got(S.search(S.Index(df), queries, 3)) == plain_search(docs, items, 3)


def test_bounds_are_never_below_scores():
    rng = random.Random(10)
    texts = [prose(rng, rng.randint(1, 200)).encode() for _ in range(60)]
    counts = [S.term_counts(t) for t in texts]
    total, length = len(texts), sum(c.total() for c in counts)
    query = {t: rng.randrange(1, 9000) for c in counts[:5] for t in list(c)[:9]}
    block = S._Block({0: query}, total, length)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(60)), "mark": [0] * 60, "text": texts})
    (sketches,) = S._sketched(total, length)([batch])
    ((_, bounds),) = S._bounds(block, sketches)
    scores = [block.score(0, c, S.length_factor(c.total(), total, length)) for c in counts]
    assert all(b >= s for b, s in zip(bounds, scores)) and max(scores) > 0


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = ("Één, two;THREE-42 " * 40).encode()
    want = plain_terms(text.decode())
    assert {t.decode(): n for t, n in S.term_counts(text).items()} == want
    monkeypatch.setattr(S, "PIECE_BYTES", 7)
    assert {t.decode(): n for t, n in S.term_counts(text).items()} == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert S.search_digest(none, asked).count() == 0
    assert S.search_digest(some, asked.limit(0)).count() == 0
