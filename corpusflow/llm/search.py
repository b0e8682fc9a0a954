"""Ranked lexical search with hashed max-sketches.

Index: each document's impacts (what one of its terms adds to a score, before the term's
weight) fold into WIDTH coordinates by the term's hash, keeping the greatest of each in steps
rounded up. For any query the sum of its weights times the coordinates of its terms is an
upper bound of the document's score.

Search: queries come in blocks of bounded size. All sketches are read; the documents of the
highest bounds are scored exactly, which gives each query a threshold, the score of its k-th
document so far. Then every document whose bound reaches the threshold is scored exactly, in
rounds of falling bounds, so that the threshold of a round prunes the next. What is left has a
bound below the k-th score, so the ranking is exact.

Sketches, counts of terms and candidates are tables; only the block's terms and thresholds
travel to the tasks, and only they come to the driver.

Rows: a null or empty text has no terms and is in no ranking, a query without known terms has
none; every row is a document or a query of its own, also repeated ones; equal scores rank by
id, a null id last. Texts are read in pieces cut between terms. Empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.store import join_few, stored

TOP = 10
WIDTH = 4096
STEP = 4096  # an impact is below 10^6, so a coordinate fits in a byte
BLOCK_BYTES = 1 << 20
PIECE_BYTES = 1 << 20
HELD_TERMS = 200_000
SKETCH_ROWS = 2048
ROUNDS = (4, 64)  # documents of a query by bound, in multiples of k, before the last round
BROADCAST_ROWS = 500_000
SEPARATORS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
#: Separators become blanks and A-Z lower case; all other bytes belong to terms.
TERM_BYTES = bytes(0x20 if b in SEPARATORS else b + 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))
BORDER = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")


def term_counts(text: bytes) -> Counter:
    """The terms of a UTF-8 text and how often each occurs."""
    if len(text) <= PIECE_BYTES:
        return Counter(text.translate(TERM_BYTES).split())
    found: Counter = Counter()
    at = 0
    while at < len(text):
        border = BORDER.search(text, at + PIECE_BYTES)
        end = border.start() if border else len(text)
        found.update(text[at:end].translate(TERM_BYTES).split())
        at = end
    return found


def length_factor(n: int, documents: int, length: int) -> int:
    return 100 - 75 + (75 * n * documents) // length


def impact(tf: int, m: int) -> int:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def coordinate(term: bytes) -> int:
    return zlib.crc32(term) % WIDTH


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for text in batch.column("text").cast(pa.binary()):
        yield text.as_py() or b""


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    documents, length = 0, 0

    def out() -> pa.RecordBatch:
        terms, counts = [*held, None], [*held.values(), documents]
        lengths = [0] * len(held) + [length]
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.binary()), pa.array(counts, pa.int64()), pa.array(lengths, pa.int64())], ["term", "df", "length"]
        )

    for batch in batches:
        for text in _texts(batch):
            found = term_counts(text)
            held.update(found.keys())
            documents += bool(found)
            length += found.total()
            if len(held) > HELD_TERMS:
                yield out()
                documents, length = 0, 0
    yield out()


def term_table(documents: DataFrame) -> DataFrame:
    """``term``, ``df``, and under the null term the number of documents and their ``length``."""
    counts = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(_counted, "term binary, df long, length long")
    return counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("length").alias("length"))


def _sketched(total: int, length: int):
    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, tops = [], []
            for text in _texts(batch):
                found = term_counts(text)
                top = np.zeros(WIDTH, np.uint8)
                if found:
                    m = length_factor(found.total(), total, length)
                    at = np.fromiter(map(zlib.crc32, found), np.int64, len(found)) % WIDTH
                    tf = np.fromiter(found.values(), np.int64, len(found))
                    impacts = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
                    np.maximum.at(top, at, (-(-impacts // STEP)).astype(np.uint8))
                used = np.flatnonzero(top)
                cells.append(used.astype(np.uint16).tobytes())
                tops.append(top[used].tobytes())
            columns = [batch.column("doc_id"), batch.column("mark"), pa.array(cells, pa.binary()), pa.array(tops, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "cells", "tops"])

    return sketched


def _marked(documents: DataFrame) -> DataFrame:
    """Rows as doc_id, text and a ``mark`` that tells texts of one id apart."""
    text = F.col("text").cast("string")
    return documents.select("doc_id", F.xxhash64(text).alias("mark"), text.alias("text"))


class Index:
    """Sketches of all documents, the counts of all terms, and the documents' own table."""

    def __init__(self, documents: DataFrame):
        self.documents = _marked(documents)
        self.id_type = dict(self.documents.dtypes)["doc_id"]
        self.terms = stored(term_table(documents), "search-terms")
        row = self.terms.filter("term IS NULL").first()
        self.total, self.length = (row.df, row.length) if row else (0, 0)
        schema = f"doc_id {self.id_type}, mark long, cells binary, tops binary"
        self.sketches = stored(self.documents.mapInArrow(_sketched(self.total, self.length), schema), "search-sketches")


class _Block:
    """The queries of a block: for each its terms' weights, times their occurrences in it."""

    def __init__(self, queries: dict[int, dict[bytes, int]], total: int, length: int):
        self.queries, self.total, self.length = queries, total, length

    def sums(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Coordinates and summed weights of each query."""
        out = {}
        for q, terms in self.queries.items():
            found: Counter = Counter()
            for term, w in terms.items():
                found[coordinate(term)] += w
            out[q] = np.array(list(found), np.int64), np.array(list(found.values()), np.float64)
        return out

    def score(self, q: int, found: Counter, m: int) -> int:
        return sum(w * impact(found[t], m) for t, w in self.queries[q].items() if t in found)


def _bounds(block: _Block, sketches: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """For each query the upper bounds of a few documents; sums stay far below 2^53."""
    cells = [np.frombuffer(c, np.uint16) for c in sketches.column("cells").to_pylist()]
    tops = [np.frombuffer(t, np.uint8) for t in sketches.column("tops").to_pylist()]
    rows = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
    dense = np.zeros((WIDTH, len(cells)), np.uint8)
    dense[np.concatenate(cells), rows] = np.concatenate(tops)
    for q, (at, weights) in block.sums().items():
        yield q, (weights @ dense[at].astype(np.float64)) * STEP


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SKETCH_ROWS):
            yield batch.slice(at, SKETCH_ROWS)


def _best(block: _Block, most: int):
    """The documents of the highest bounds of each query in one task."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, pa.Table] = {}
        for part in _slices(batches):
            named = pa.Table.from_batches([part.select(["doc_id", "mark"])])
            for q, bounds in _bounds(block, part):
                take = np.argpartition(-bounds, most)[:most] if len(bounds) > most else np.arange(len(bounds))
                take = take[bounds[take] > 0]
                found = named.take(pa.array(take)).append_column("bound", pa.array(bounds[take]))
                if q in held:
                    found = pa.concat_tables([held[q], found])
                    found = found.take(np.argsort(-found.column("bound").to_numpy(), kind="stable")[:most])
                held[q] = found
        for q, found in held.items():
            yield from found.append_column("q", pa.array(np.full(found.num_rows, q))).to_batches()

    return best


def _reaching(block: _Block, least: dict[int, int]):
    """All documents whose bound reaches their query's threshold."""

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            named = pa.Table.from_batches([part.select(["doc_id", "mark"])])
            for q, bounds in _bounds(block, part):
                take = np.flatnonzero(bounds >= least.get(q, 1))
                if len(take):
                    found = named.take(pa.array(take)).append_column("bound", pa.array(bounds[take]))
                    yield from found.append_column("q", pa.array(np.full(len(take), q))).to_batches()

    return reaching


def _scored(block: _Block):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, asked, scores = [], [], []
            for k, (text, qs) in enumerate(zip(_texts(batch), batch.column("qs"))):
                found = term_counts(text)
                if not found:
                    continue
                m = length_factor(found.total(), block.total, block.length)
                for q in qs.as_py():
                    value = block.score(q, found, m)
                    if value > 0:
                        rows.append(k)
                        asked.append(q)
                        scores.append(value)
            ids = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            columns = [pa.array(asked, pa.int64()), ids, pa.array(scores, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["q", "doc_id", "score"])

    return scored


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scores.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def _exact(index: Index, block: _Block, found: DataFrame, k: int) -> DataFrame:
    """The k best of some candidates (q, doc_id, mark), scored on their texts; stored."""
    asked = found.groupBy("doc_id", "mark").agg(F.collect_set("q").alias("qs"))
    asked = stored(asked.withColumnsRenamed({"doc_id": "_id", "mark": "_mark"}), "search-asked")
    few = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
    texts = index.documents.join(few, same).select("doc_id", "text", "qs")
    return stored(_ranked(texts.mapInArrow(_scored(block), f"q long, doc_id {index.id_type}, score long"), k), "search-scores")


def _thresholds(best: DataFrame, k: int) -> dict[int, int]:
    return {r.q: r.score for r in best.filter(F.col("rank") == k).collect()}


def search_block(index: Index, block: _Block, k: int = TOP) -> DataFrame:
    """``q``, ``rank``, ``doc_id``, ``score`` of a block's queries."""
    schema = f"doc_id {index.id_type}, mark long, bound double, q long"
    by = Window.partitionBy("q").orderBy(F.desc("bound"))
    least: dict[int, int] = {}
    for most in ROUNDS:
        found = index.sketches.mapInArrow(_best(block, most * k), schema)
        found = found.withColumn("_place", F.row_number().over(by)).filter(F.col("_place") <= most * k)
        if least:
            known = index.sketches.sparkSession.createDataFrame(list(least.items()), "q long, least long")
            found = found.join(F.broadcast(known), "q", "left").filter("least IS NULL OR bound >= least")
        least = _thresholds(_exact(index, block, found, k), k)
    return _exact(index, block, index.sketches.mapInArrow(_reaching(block, least), schema), k)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for q, text in zip(batch.column("q").to_pylist(), _texts(batch)):
            found = term_counts(text)
            columns = [pa.array([q] * len(found), pa.int64()), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["q", "term", "times"])


def search(index: Index, queries: DataFrame, k: int = TOP) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: each query's k best documents.

    ``queries``: item_id and text.
    """
    text = F.col("text").cast("string")
    items = queries.select(F.monotonically_increasing_id().alias("q"), "item_id", text.alias("text"))
    items = stored(items, "search-items")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-size // BLOCK_BYTES)
    terms = items.select("q", "text").mapInArrow(_split, "q long, term binary, times long")
    terms = stored(terms.join(index.terms.select("term", "df"), "term"), "search-query-terms")
    found = items.sparkSession.createDataFrame([], f"q long, doc_id {index.id_type}, score long, rank int")
    for number in range(blocks):
        rows = terms.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == number).toLocalIterator()
        asked: dict[int, dict[bytes, int]] = {}
        for row in rows:
            asked.setdefault(row.q, {})[bytes(row.term)] = row.times * weight(index.total, row.df)
        if asked:
            found = found.union(search_block(index, _Block(asked, index.total, index.length), k))
    return found.join(items.select("q", "item_id"), "q").select("item_id", F.col("rank").cast("int"), "doc_id", "score")


def search_digest(documents: DataFrame, queries: DataFrame) -> DataFrame:
    return search(Index(documents), queries)


def _terms_sql(name: str, item: str) -> str:
    return rf"""SELECT {item}, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) AS term FROM {name}"""


SQL = f"""
WITH d AS (SELECT doc_id, term, count(*) AS tf FROM ({_terms_sql("documents", "doc_id")}) GROUP BY ALL),
q AS (SELECT item_id, term, count(*) AS times FROM ({_terms_sql("benchmark", "item_id")}) GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM d GROUP BY doc_id),
t AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM n),
m AS (SELECT doc_id, 25 + (75 * n * docs) // total AS m FROM n, t),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w
      FROM (SELECT term, count(*) AS df FROM d GROUP BY term), t),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN d USING (term) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
      FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10"""
