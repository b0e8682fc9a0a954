"""Secret scans with a trigram inverted index.

From the parse tree of each rule's pattern comes a Boolean query: alternatives, each a set of
trigrams that a text must hold (in lower case) to match. The index lists, for each trigram of
these queries, the texts that hold it. Postings are intersected by counting, per text and
alternative, the trigrams found; only texts with a full alternative are verified with the
pattern. A rule without mandatory trigrams scans every text.

Spans come from the pieces between matches, which, together with the matches, make up the
text: so offsets are sums of lengths in code points, and the leftmost, non-overlapping
matches are those of the regular expression engine itself.

Rows: a null text is empty. Texts are filed under a hash of id and text: equal rows share
postings, and a collision can only cause a needless verification. Null ids and repeated rows
need no care. An empty table gives no rows. Only doc_id and text are used.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.store import join_few, let, stored

BROADCAST_CANDIDATES = 500_000
MAX_STRINGS = 64  # literal strings that are multiplied out before a query is cut in two


@dataclass(frozen=True)
class SecretRule:
    """``pattern`` finds matches; those with under ``least`` characters in ``group`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# The patterns and least lengths of the base kinds, in their order.
BASE_RULES = [
    SecretRule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
        True,
    ),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    SecretRule("hex", r"[0-9a-f]+", 0, 16, True),
]
RULES = [
    *BASE_RULES,
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    SecretRule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    SecretRule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
]

Query = list[frozenset[str]]  # any of these sets of trigrams; no set at all: no restriction


def _either(a: Query, b: Query) -> Query:
    return _least(a + b) if a and b else []


def _both(a: Query, b: Query) -> Query:
    return _least([x | y for x in a for y in b]) if a and b else a or b


def _least(query: Query) -> Query:
    found = list(dict.fromkeys(query))
    return [x for x in found if not any(y < x for y in found)]


def _of_strings(strings: set[str]) -> Query:
    sets = [frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in sorted(strings)]
    return _least(sets) if sets and all(sets) else []


def _parts(nodes) -> tuple[set[str] | None, Query]:
    """All strings that a sequence of nodes can match, if few, and a query that they imply."""
    held: set[str] = {""}
    exact, query = True, []
    for node in nodes:
        strings, implied = _part(node)
        if strings is not None and len(held) * len(strings) <= MAX_STRINGS:
            held = {a + b for a, b in itertools.product(held, strings)}
            continue
        once = _once(node)
        if once is not None and len(held) * len(once) <= MAX_STRINGS:
            held = {a + b for a, b in itertools.product(held, once)}
        query = _both(_both(query, _of_strings(held)), implied)
        held, exact = strings or {""}, False
    return (held if exact else None), _both(query, _of_strings(held))


def _once(node) -> set[str] | None:
    """The strings of a part that is repeated once at least."""
    if str(node[0]) in ("MAX_REPEAT", "MIN_REPEAT") and node[1][0]:
        return _parts(node[1][2])[0]
    return None


def _part(node) -> tuple[set[str] | None, Query]:
    kind, value = str(node[0]), node[1]
    if kind == "LITERAL":
        return {chr(value).lower()}, []
    if kind == "IN":
        letters: set[str] = set()
        for what, x in value:
            if str(what) == "LITERAL":
                letters.add(chr(x).lower())
            elif str(what) == "RANGE" and x[1] - x[0] < MAX_STRINGS:
                letters.update(chr(c).lower() for c in range(x[0], x[1] + 1))
            else:
                return None, []
        return (letters if len(letters) <= 8 else None), []
    if kind == "SUBPATTERN":
        return _parts(value[-1])
    if kind == "BRANCH":
        every = [_parts(branch) for branch in value[1]]
        strings = set().union(*(s for s, _ in every)) if all(s is not None for s, _ in every) else None
        query = every[0][1]
        for _, other in every[1:]:
            query = _either(query, other)
        return strings, query
    if kind in ("MAX_REPEAT", "MIN_REPEAT"):
        low, high, inner = value
        strings, query = _parts(inner)
        if low == 0 and high == 1 and strings is not None:
            return strings | {""}, []
        if low == high and low <= 8 and strings is not None and len(strings) ** low <= MAX_STRINGS:
            return {"".join(p) for p in itertools.product(strings, repeat=low)}, []
        return None, (query if low else [])
    return None, []


def trigram_query(pattern: str) -> Query:
    """Alternatives of mandatory trigrams, in lower case; empty: the rule must scan."""
    strings, query = _parts(re._parser.parse(pattern))
    return _of_strings(strings) if strings is not None else query


def _key() -> Column:
    return F.xxhash64("doc_id", F.col("text").cast("string"))


def postings(documents: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index for these trigrams: ``trigram`` and the key of each text that holds it."""
    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    listed = F.array(*map(F.lit, trigrams))
    held = let(text, lambda low: F.filter(listed, lambda t: F.contains(low, t)))
    return documents.select(_key().alias("_key"), F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: list[SecretRule]) -> DataFrame:
    """Per key, the rules (bits of ``_rules``) of which an alternative has all its trigrams."""
    sets = [(k, trigrams) for k, rule in enumerate(rules) for trigrams in trigram_query(rule.pattern)]
    by_trigram: dict[str, list[int]] = {}
    for n, (_, trigrams) in enumerate(sets):
        for trigram in sorted(trigrams):
            by_trigram.setdefault(trigram, []).append(n)
    lists = F.create_map(
        *itertools.chain.from_iterable((F.lit(t), F.array(*map(F.lit, ns))) for t, ns in sorted(by_trigram.items()))
    )
    needs = F.array(*(F.lit(len(trigrams)) for _, trigrams in sets))
    bit = F.array(*(F.lit(1 << k) for k, _ in sets))
    found = index.select("_key", F.explode(F.element_at(lists, F.col("trigram"))).alias("_set"))
    found = found.groupBy("_key", "_set").agg(F.count(F.lit(1)).alias("_n"))
    return (
        found.filter(F.col("_n") >= F.get(needs, F.col("_set")))
        .groupBy("_key")
        .agg(F.bit_or(F.get(bit, F.col("_set"))).alias("_rules"))
    )


def _spans(rank: int, rule: SecretRule) -> Column:
    """Spans of one rule in ``text``, as structs of start, rank, kind and end."""
    pattern = F.lit(rule.pattern)
    text = F.col("text")
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    pieces = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
    lengths = F.transform(found, lambda x: F.length(x))

    def walk(sizes: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
        step = lambda s, x: F.struct(
            (s["at"] + x["piece"] + x["length"]).alias("at"),
            F.array_append(
                s["spans"],
                F.struct((s["at"] + x["piece"]).alias("start"), (s["at"] + x["piece"] + x["length"]).alias("end")),
            ).alias("spans"),
        )
        return F.aggregate(sizes, begin, step)["spans"]

    sizes = F.zip_with(F.slice(pieces, 1, F.size(lengths)), lengths, lambda a, b: F.struct(a.alias("piece"), b.alias("length")))
    spans = F.zip_with(
        let(sizes, walk),
        tested,
        lambda span, x: F.struct(
            span["start"].alias("start"),
            F.lit(rank).alias("rank"),
            F.lit(rule.kind).alias("kind"),
            span["end"].alias("end"),
            F.length(x).alias("tested"),
        ),
    )
    return F.filter(spans, lambda s: s["tested"] >= rule.least)


NO_SPANS = "array<struct<start:int,rank:int,kind:string,end:int,tested:int>>"


def _scanned(rule: SecretRule) -> SecretRule:
    """A rule that is one repeated class can look for runs of the least length at once."""
    if rule.group == 0 and re.fullmatch(r"\[[^\]]+\]\+", rule.pattern):
        return SecretRule(rule.kind, f"{rule.pattern[:-1]}{{{rule.least},}}", 0, rule.least, rule.base)
    return rule


def find_secrets(documents: DataFrame, rules: list[SecretRule] | None = None) -> DataFrame:
    """``doc_id`` and ``spans``: sorted structs of start, rank, kind, end (code points)."""
    rules = RULES if rules is None else rules
    queries = [trigram_query(rule.pattern) for rule in rules]
    trigrams = sorted({t for query in queries for option in query for t in option})
    texts = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.withColumn("_key", _key())
    if trigrams:
        found = stored(candidates(postings(texts, trigrams), rules), "secret-candidates")
        rows = join_few(rows, found, ["_key"], found.count(), BROADCAST_CANDIDATES)
    else:
        rows = rows.withColumn("_rules", F.lit(0))
    every = []
    for k, (rule, query) in enumerate(zip(rules, queries)):
        if query:
            is_candidate = F.coalesce(F.col("_rules"), F.lit(0)).bitwiseAND(F.lit(1 << k)) != 0
        else:
            rule = _scanned(rule)
            is_candidate = F.col("text").rlike(rule.pattern)
        every.append(F.when(is_candidate, _spans(k, rule)).otherwise(F.array().cast(NO_SPANS)))
    return rows.select("doc_id", F.array_sort(F.concat(*every)).alias("spans"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_digest(documents: DataFrame) -> DataFrame:
    bases = [rule.kind for rule in RULES if rule.base]
    base = F.filter("spans", lambda s: s["rank"] < len(bases))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return find_secrets(documents).select(
        "doc_id",
        *map(number, bases),
        F.sha2(_written(base), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
    )


def _sql() -> str:
    """The same result by scanning every text with every pattern."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    scans = []
    for k, rule in enumerate(RULES):
        pattern = quoted(rule.pattern)
        scans.append(
            f"SELECT doc_id, {k} AS rank, '{rule.kind}' AS kind, {rule.least} AS least, "
            f"regexp_extract_all(t, {pattern}) AS ms, regexp_extract_all(t, {pattern}, {rule.group}) AS gs, "
            f"string_split_regex(t, {pattern}) AS ps FROM texts"
        )
    union = "\n  UNION ALL ".join(scans)
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
scans AS (
  {union}
), numbered AS (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM scans),
spans AS (
  SELECT doc_id, rank, kind,
         CAST(list_sum(list_transform(ps[1:k], lambda x: length(x)))
              + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS s,
         length(ms[k]) AS n
  FROM numbered WHERE length(gs[k]) >= least
)
SELECT d.doc_id,
       count(*) FILTER (kind = 'assign') AS n_assign,
       count(*) FILTER (kind = 'access') AS n_access,
       count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) FILTER (rank < 3), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) FILTER (kind IS NOT NULL), '') AS spans
FROM texts d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id
"""


SQL = _sql()
