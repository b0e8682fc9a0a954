import random
import re
import zlib
from collections import Counter

import pytest

from corpusflow.llm import variants as V
from llm.conftest import DOCUMENTS

NAMES = ["word", "form", "root", "n", "n_near", "form_n"]


def plain_near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(rows) -> set:
    n = Counter()
    for doc_id, text in rows:
        doc = "" if doc_id is None else str(doc_id)
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 2}
    near = {w: [v for v in n if plain_near(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def got(df) -> list:
    assert df.columns == NAMES
    return [tuple(r) for r in df.collect()]


def test_equals_plain_loops(spark, rows, documents):
    want = plain_variants([(r[0], r[1]) for r in rows])
    out = got(V.spelling_variants(documents))
    assert len(out) == len(want) and set(out) == want


def test_dense_neighbourhoods_and_chains(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("ab", k=rng.randint(7, 9))) for _ in range(250)]
    words += ["aaaaaaaaa", "aaaaaaaa", "aaaaaaa", "abababab", "étéétéét", "Étéétéét"]
    chain = ["receive"] * 900 + ["recieve"] * 3 + ["receeve"] * 60 + ["receevee"] * 5
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(6)] + [" ".join(chain), "RECEIVE-receiveİreceive"]
    rows = [(k, t) for k, t in enumerate(texts)]
    want = plain_variants(rows)
    out = got(V.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert len(out) == len(want) and set(out) == want
    assert any(w[1] is not None and w[2] != w[1] for w in want)


def test_every_near_pair_is_found(spark):
    """Random words and edits of them at every place, with repeated letters."""
    rng = random.Random(4)
    words = set()
    for _ in range(150):
        w = "".join(rng.choices("abcxyz", k=rng.randint(7, 11)))
        k = rng.randrange(len(w) + 1)
        words |= {w, w[:k] + rng.choice("abcxyz") + w[k:], w[:k] + w[k + 1 :], w[:k] + "q" + w[k + 1 :]}
    words = sorted(w for w in words if len(w) >= 7)
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    found = {(r.a, r.b) for r in V.near_pairs(df).collect()}
    assert found == {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if plain_near(a, b)}


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = random.Random(5)
    for _ in range(200):
        ranks = [rng.randrange(6) for _ in range(rng.randint(6, 12))]
        firsts, seconds = [[rng.randrange(20) for _ in ranks] for _ in range(2)]
        places = V.prefix_places(ranks)
        a, b = V.pivots(places, firsts, seconds)
        assert b - a >= 2 and {a, b} <= set(places)
        assert firsts[a] + seconds[b] == min(firsts[p] + seconds[q] for p in places for q in places if q - p >= 2)


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(V, "PIECE_BYTES", 5)
    text = "Schöneres wetter, immerhin " * 20
    assert "".join(V.pieces(text.encode())) == "".join(c.lower() if c < "\x80" else c for c in text)
    assert all(not p[0].isalpha() for p in list(V.pieces(text.encode()))[1:])


@pytest.mark.parametrize("rows", [[], [(1, None), (None, None)], [(1, "short words only"), (2, "uniqueword")]])
def test_nothing_to_tell(spark, rows):
    assert V.spelling_variants(spark.createDataFrame(rows, DOCUMENTS.split(", lang")[0])).count() == 0
