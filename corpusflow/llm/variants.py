"""Spelling variants: words one edit apart, found by pivotal grams.

Bigrams have one order over the vocabulary, rare ones first. A word's prefix are its five
first bigrams in that order, with every further place of the last. Two disjoint bigrams of
the prefix are its pivots. One edit leaves a pivot whole, and if the other word's prefix
reaches as far in the order, that pivot stands in it: so pivots are looked up among the
prefixes of words whose prefix ends at the same bigram or later. Three bigrams would always
hold two disjoint ones; five leave a choice.

The position limit is exact. An edit behind the first pivot leaves everything up to that
pivot as it was, an edit before leaves everything from the second pivot on. So the first pivot
is filed with the text before it, the second with the text behind it, and a prefix bigram
under both; pairs that meet are verified by edit distance. Dynamic programming chooses the
pivots whose files should be least: rare bigrams behind (before) rare text, as a chain of
bigrams tells it.

There are at most 90 letters, so at most 8,100 bigrams: their frequencies are a bounded table
and travel with the tasks.

Rows: a null text has no words, a null id is spelled as no characters, every row counts, also
a repeated one. Texts are read in pieces cut at an ASCII character that is no letter, so a
text of any length needs little memory. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.store import stored

LEAST_LENGTH = 7
LEAST_COUNT = 2
FORM_FACTOR = 10
SLIP = 31
PREFIX = 5
PIECE_BYTES = 1 << 20
HELD_WORDS = 200_000
# Letters are A-Z, a-z and U+00C0 to U+00FF; only A-Z are lower-cased.
RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")
BORDER = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]")


def pieces(text: bytes) -> Iterator[str]:
    """A UTF-8 text, lower-cased, in pieces that cut no run of letters."""
    at = 0
    while at < len(text):
        border = BORDER.search(text, at + PIECE_BYTES)
        end = border.start() if border else len(text)
        yield text[at:end].lower().decode("utf-8", "replace")
        at = end


def slipped(run: str, seed: int) -> str:
    """The run, less one code point if its checksum behind the document's says so."""
    h = zlib.crc32(run.encode(), seed)
    if h % SLIP:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        columns = [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, ["word", "n"])

    for batch in batches:
        for doc, text in zip(batch.column("doc_id"), batch.column("text").cast(pa.binary())):
            seed = zlib.crc32(((doc.as_py() or "") + ":").encode())
            for piece in pieces(text.as_py() or b""):
                for run, n in Counter(RUN.findall(piece)).items():
                    word = slipped(run, seed)
                    if len(word) >= LEAST_LENGTH:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield out()
    if held:
        yield out()


def vocabulary(documents: DataFrame) -> DataFrame:
    """``word`` and its occurrences ``n``, of the words that occur often enough."""
    texts = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = texts.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= LEAST_COUNT)


def gram_counts(words: DataFrame) -> dict[str, int]:
    """Places of each bigram in the vocabulary: a row for each pair of letters at most."""
    places = F.sequence(F.lit(1), F.length("word") - 1)
    grams = words.select(F.explode(F.transform(places, lambda i: F.substring("word", i, F.lit(2)))).alias("gram"))
    return dict(map(tuple, grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()))


def prefix_places(ranks: list[int]) -> list[int]:
    """Places of the bigrams up to the PREFIX-th in the order; equal ones are all in or all out."""
    last = sorted(ranks)[min(PREFIX, len(ranks)) - 1]
    return [p for p, r in enumerate(ranks) if r <= last]


def pivots(places: list[int], firsts: list[float], seconds: list[float]) -> tuple[int, int]:
    """Two disjoint places of least total weight: the cheapest first one for each second one."""
    best, chosen = None, (-1, -1)
    single, at, behind = None, -1, 0
    for p in places:
        while behind < len(places) and places[behind] <= p - 2:
            q = places[behind]
            if single is None or firsts[q] < single:
                single, at = firsts[q], q
            behind += 1
        if single is not None and (best is None or single + seconds[p] < best):
            best, chosen = single + seconds[p], (at, p)
    return chosen


class _Grams:
    """The bigrams' order, and how often a letter is followed or preceded by another."""

    def __init__(self, counts: dict[str, int]):
        self.order = {g: k for k, g in enumerate(sorted(counts, key=lambda g: (counts[g], g)))}
        before, after = Counter(), Counter()
        for g, n in counts.items():
            before[g[0]] += n
            after[g[1]] += n
        self.followed = {g: n / before[g[0]] for g, n in counts.items()}
        self.preceded = {g: n / after[g[1]] for g, n in counts.items()}

    def files(self, word: str) -> tuple[list[tuple[str, bool]], int]:
        """The word's files, with those of its pivots marked, and where its prefix ends."""
        grams = [word[p : p + 2] for p in range(len(word) - 1)]
        ranks = [self.order[g] for g in grams]
        places = prefix_places(ranks)
        firsts = list(accumulate((self.followed[g] for g in grams), mul))
        seconds = list(accumulate((self.preceded[g] for g in reversed(grams)), mul))[::-1]
        first, second = pivots(places, firsts, seconds)
        mine = [("<" + word[: p + 2], p == first) for p in places]
        return mine + [(">" + word[p:], p == second) for p in places], max(ranks[p] for p in places)


def _files(counts: dict[str, int]):
    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Grams(counts)
        for batch in batches:
            rows = []
            for word in batch.column("word").to_pylist():
                mine, last = known.files(word)
                rows += [(file, word, last, pivot) for file, pivot in mine]
            types = [pa.string(), pa.string(), pa.int32(), pa.bool_()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, types)]
            yield pa.RecordBatch.from_arrays(columns, ["file", "word", "last", "pivot"])

    return filed


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs ``a`` < ``b`` of words that differ by exactly one edit. ``words`` is read twice."""
    files = words.select("word").mapInArrow(_files(gram_counts(words)), "file string, word string, last int, pivot boolean")
    files = files.withColumn("size", F.length("word"))
    asks, holds = files.filter("pivot").alias("x"), files.alias("y")
    met = asks.join(
        holds,
        (F.col("x.file") == F.col("y.file"))
        & (F.col("x.last") <= F.col("y.last"))
        & (F.abs(F.col("x.size") - F.col("y.size")) <= 1)
        & (F.levenshtein("x.word", "y.word", 1) == 1),
    )
    return met.select(F.least("x.word", "y.word").alias("a"), F.greatest("x.word", "y.word").alias("b")).distinct()


def with_forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """Add ``n_near``, ``form`` and ``form_n`` to each word."""
    both = pairs.union(pairs.select("b", "a")).toDF("word", "other")
    other = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    most = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    best = both.join(other, "other").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), most.alias("most"))
    top = -F.col("most.less")
    found = top >= F.col("n") * FORM_FACTOR
    return words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(found, F.col("most.other")).alias("form"),
        F.when(found, top).alias("form_n"),
    )


def with_roots(forms: DataFrame) -> DataFrame:
    """Add ``root``: where a word's forms lead. Steps double; counts grow tenfold a step, so few rounds do."""
    steps = stored(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "variant-steps")
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        moved = stored(steps.join(on, "root", "left"), "variant-steps")
        if moved.filter("_on IS NOT NULL").isEmpty():
            break
        steps = moved.select("word", F.coalesce("_on", "root").alias("root"))
    return forms.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(documents: DataFrame) -> DataFrame:
    """Each word with its near words' number, its form, and the root its forms lead to."""
    words = stored(vocabulary(documents), "variant-words")
    forms = stored(with_forms(words, near_pairs(words)), "variant-forms")
    return with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")


def _checksum_steps() -> list[int]:
    """The checksum's table for four bits."""
    table = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return table


SQL = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY doc_id, run),
digits AS (SELECT *, hex(coalesce(doc_id::VARCHAR, '') || ':' || run) AS h FROM runs),
sums AS (
  SELECT run, n, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(length(h)), lambda i: (strpos('0123456789ABCDEF', substr(h, (i // 2) * 2 + 2 - i % 2, 1)) - 1)::BIGINT)),
    lambda c, d: xor(list_extract({_checksum_steps()}, xor(c, d) % 16 + 1), c // 16))) AS h FROM digits),
slips AS (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
                         ELSE run END AS word FROM sums),
v AS (SELECT word, sum(n)::BIGINT AS n FROM slips WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less
      FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (
  SELECT a.word, b.word AS other FROM d a JOIN d b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT d.word, v.word FROM d JOIN v ON d.less = v.word
  UNION SELECT v.word, d.word FROM d JOIN v ON d.less = v.word),
best AS (SELECT near.word, count(*) AS n_near, max(o.n) AS top FROM near JOIN v o ON o.word = near.other GROUP BY near.word),
named AS (SELECT near.word, min(near.other) AS other FROM near JOIN v o ON o.word = near.other
          JOIN best ON best.word = near.word AND best.top = o.n GROUP BY near.word),
forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * v.n THEN other END AS form,
         CASE WHEN top >= 10 * v.n THEN top END AS form_n
  FROM v LEFT JOIN best ON best.word = v.word LEFT JOIN named ON named.word = v.word),
walk AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n
FROM forms f JOIN walk ON walk.word = f.word JOIN forms e ON e.word = walk.root AND e.form IS NULL"""
