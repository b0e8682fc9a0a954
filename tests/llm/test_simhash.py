import random
import re

import pytest
import xxhash

from corpusflow.llm import graph, simhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_print(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, near):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = sorted(nodes)
    for k, a in enumerate(nodes):
        for b in nodes[k + 1 :]:
            if near(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def expected(rows):
    prints = [(i, brute_print(t)) for i, t, *_ in rows]
    root = classes({p for _, p in prints}, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    return sorted(((i, f"{p:016x}", least.get(root[p])) for i, p in prints), key=str)


def test_equals_brute_force(documents, rows):
    assert sorted(map(tuple, simhash.simhash_digest(documents).collect()), key=str) == expected(rows)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("full", [1000, 3, 1])
def test_links_of_dense_groups(spark, full):
    rng = random.Random(full)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = {0, (1 << 64) - 1}
    for c in centres:
        prints |= {c ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 4))}) for _ in range(25)}
    df = spark.createDataFrame([(k, signed(p)) for k, p in enumerate(sorted(prints))], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.with_components(df, full).collect()}
    order = sorted(prints)
    root = classes(range(len(order)), lambda a, b: (order[a] ^ order[b]).bit_count() <= 3)
    assert got == root


def test_links_are_close(spark):
    rng = random.Random(2)
    c = rng.getrandbits(64)
    prints = {c ^ sum({1 << rng.randrange(64) for _ in range(4)}) for _ in range(80)}
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    for full in (1, 1000):
        for a, b in simhash.links(df, full).collect():
            assert ((a ^ b) & (2**64 - 1)).bit_count() <= 3


def test_components(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(5, 5), (2000, 2001), (2001, 2000)]
    links += [(rng.randrange(3000, 3300), rng.randrange(3000, 3300)) for _ in range(250)]
    rng.shuffle(links)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    pairs = {tuple(sorted(p)) for p in links}
    root = classes({n for p in links for n in p}, lambda a, b: (a, b) in pairs)
    assert got == {n: r for n, r in root.items() if n != r}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(documents, rows):
    kept = simhash.drop_near_copies(documents)
    assert kept.columns == documents.columns
    groups = {}
    for i, _, c in expected(rows):
        groups.setdefault(c, set()).add(i)
    got = [r.doc_id for r in kept.collect()]
    assert sorted(got, key=str) == sorted((c for c in groups), key=str)


def test_no_rows(nothing):
    assert simhash.simhash_digest(nothing).count() == 0 and simhash.drop_near_copies(nothing).count() == 0
