import hashlib
import random
import re

import pytest

from corpusflow.llm import secrets


def brute(text, rules=None):
    found = []
    for rank, rule in enumerate(rules or secrets.RULES):
        pattern = re.compile(rule.pattern, re.ASCII)
        for m in pattern.finditer(text or ""):
            if len(m.group(rule.group)) >= rule.least:
                found.append((m.start(), rank, rule.kind, m.end()))
    return sorted(found)


def written(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)


PIECES = [
    "password=", "PassWd : '", 'secret:"', "token = ", "api_key=", "apikey:", "AKIA", "abcdef0123456789", "0123", "Zz9_.=-/+", "ABCDEFGHIJKLMN",
    " ", "\n", "ghp_", "xoxb-1-", "eyJhbGciOiJI.", "-----BEGIN RSA PRIVATE KEY-----", "é字", "tok", "en", "q" * 13, "word",
]


def texts(seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 30))) for _ in range(120)] + [
        "password=token: abcdefghijklmnop",
        "secret=short token=abcdefghijklmnopqrst",
        "AKIAAKIA" + "A" * 20,
        "f" * 15 + "g" + "f" * 16,
        "token=" + "a1" * 40_000,
        None,
        "",
    ]


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rows = list(enumerate(texts(seed)))
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, spans string, _key long").repartition(3)
    got = {r.doc_id: r for r in secrets.secret_digest(df).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        spans = brute(text)
        base = [s for s in spans if s[1] < 3]
        kinds = [s[2] for s in spans]
        assert got[i].spans == written(spans)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(map(kinds.count, ("assign", "access", "hex")))
        assert got[i].base_sha256 == hashlib.sha256(written(base).encode()).hexdigest()


def test_shuffled_candidates_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(secrets, "BROADCAST_CANDIDATES", 0)
    rows = [(k % 9 or None, t) for k, t in enumerate(texts(5))] * 2
    got = secrets.secret_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.spans) for r in got), key=str) == sorted(((i, written(brute(t))) for i, t in rows), key=str)


def test_no_rows(nothing):
    assert secrets.secret_digest(nothing).count() == 0


def test_rules_without_trigrams_scan(spark):
    rules = [secrets.SecretRule("ab", r"[ab]+", 0, 3), secrets.SecretRule("two", r"x[0-9]?y", 0, 2)]
    assert [secrets.trigram_query(r.pattern) for r in rules] == [[], []]
    rows = list(enumerate(["aab xy", "x1y abab", "zz", None]))
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), rules).collect()
    assert {r.doc_id: [(s.start, s.rank, s.kind, s.end) for s in r.spans] for r in got} == {i: brute(t, rules) for i, t in rows}


@pytest.mark.parametrize("rule", secrets.RULES, ids=lambda r: r.kind)
def test_queries_hold_for_matches(rule):
    """A text that matches holds all trigrams of an alternative."""
    query = secrets.trigram_query(rule.pattern)
    assert bool(query) == (rule.kind != "hex")
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choices(PIECES, k=6))
        if query and re.search(rule.pattern, text):
            assert any(all(t in text.lower() for t in option) for option in query)


@pytest.mark.parametrize(
    "pattern, query",
    [
        ("abcd", [{"abc", "bcd"}]),
        ("abc|xyz", [{"abc"}, {"xyz"}]),
        ("abc|x", []),
        ("ab[cd]", [{"abc"}, {"abd"}]),
        ("ab.?cde", [{"cde"}]),
        ("(abc)*xyz+", [{"xyz"}]),
        ("(abc)+", [{"abc"}]),
        ("a{3}", [{"aaa"}]),
        ("ABC", [{"abc"}]),
        ("[a-z]+", []),
    ],
)
def test_trigram_queries(pattern, query):
    assert sorted(map(sorted, secrets.trigram_query(pattern))) == sorted(map(sorted, query))


def test_native(documents):
    plan = secrets.secret_digest(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
