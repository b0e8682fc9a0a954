"""Language-model scores of documents: a word unigram base and a causal attention model.

Documents whose id hashes to the held-out fold are scored but not learned from. Both models
take their counts from all training documents:

- the base counts lower-case words and text ends; a document's words meet the counts either
  by a broadcast of the counts, up to BROADCAST_WORDS words, or by a shuffle of both;
- the attention model (see ``attention``) works on subword ids of a public tokenizer. It
  gives the class of each id; only counts of classes behind two classes, a table of fixed size,
  are held in tasks. An id within its class follows from the two ids before: such cells are a
  table that grows with the corpus, and the cells of the texts meet it by a shuffle of both.
  The weights are fitted where the training ids lie: in every round each task passes over
  windows of all its texts, and the weights of all tasks are averaged by windows. The rounds share
  all windows out among them, and each goes through its own in up to TRAIN_EVERY portions; a corpus
  of fewer than TRAIN_WINDOWS is gone through in more rounds. Every window is learned from.

The text that is scored is the sequence of lower-case words with single spaces, as for the
base, so both models spread one probability over the same texts.

Ids are made once and stored, two bytes each. Texts are scored where their ids lie.

Rows: a null text is empty: one token, the end. A null id counts as the text "" in the fold.
Rows are scored by themselves, so repeated ids are no matter; equal rows count as often as
they stand. Without training documents all counts are 0 and the scores follow from the
smoothing alone. An empty table gives no rows. Only doc_id and text are used.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import attention, wordbytes
from corpusflow.llm.store import released, stored

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed values of that tokenizer: how texts are split, the size of its vocabulary, a free id.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY, END = 50_257, 50_256
FOLDS, HELD_FOLD = 5, 1
TRAIN_EVERY, TRAIN_WINDOWS = 16, 200_000
FEWEST_ROUNDS, MOST_ROUNDS = 2, 5
TRAIN_IDS = 4_000_000  # ids that a task holds at once to learn from
BROADCAST_WORDS = 12_000_000
PIECE = 1 << 16  # characters given to the tokenizer at once

WORD_BYTES = wordbytes.byte_class([(0x20, 0x20), (0x09, 0x0D)])
END_HASH = np.int64(1)  # stands for the end of a text among the hashes of words


def held_out() -> Column:
    """Whether the fold of the row's id is held out."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(F.encode(name, "UTF-8")) % FOLDS == HELD_FOLD


def encoder(path: str):
    """A function from texts to arrays of ids, the end included."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoding = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        parts, at = [], 0
        while at < len(text):
            end = at + PIECE
            space = text.rfind(" ", at + 1, end)
            if end < len(text) and space > 0:  # a long text is cut in front of a word
                end = space
            parts += encoding.encode_ordinary(text[at:end])
            at = end
        return np.array([*parts, END], np.uint16)

    return encode


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        encode = encoder(path)
        for batch in batches:
            words = (t.lower().split() for t in wordbytes.texts_of(batch.column("text")))
            ids = [encode((b" " + b" ".join(w) if w else b"").decode()).tobytes() for w in words]
            kept = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(ids, pa.binary())], [*kept, "ids"])

    return run


def _arrays(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for ids in batch.column("ids"):
        yield np.frombuffer(ids.as_buffer(), np.uint16).astype(np.int64)


def _count_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(VOCABULARY, np.int64)
    for batch in batches:
        for ids in _arrays(batch):
            counts += np.bincount(ids, minlength=VOCABULARY)
    found = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["id", "n"])


HELD_CELLS = 4_000_000
SCORED_IDS = 200_000  # ids scored at once
SENT_ROWS = 1 << 17  # rows of numbers that leave a task at once
SENT_CONTEXTS = 16  # and packed rows of class cells
MOST_COUNTED = 1 << 31  # ids that a task counts in four bytes


def _sliced(columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Number columns in batches that need little room on their way."""
    for k in range(0, len(columns[0]), SENT_ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + SENT_ROWS]) for c in columns], names)


def _held(batches: Iterator[pa.RecordBatch], cells_of) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cells of many texts at a time, each once, with their counts."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for ids in _arrays(batch):
            held.append(cells_of(ids))
            size += len(held[-1])
            if size >= HELD_CELLS:
                yield np.unique(np.concatenate(held), return_counts=True)
                held, size = [], 0
    if held:
        yield np.unique(np.concatenate(held), return_counts=True)


def _count_id_cells(classes):
    """Cells of ids with their counts, combined within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _held(batches, lambda ids: attention.id_cells(ids, classes.value)):
            yield from _sliced(list(found), ["cell", "n"])

    return run


def _count_class_cells(classes):
    """Cells of classes with their counts, combined in one table of fixed size.

    A row has those behind one class two before: ``two``, places and counts in four bytes each.
    """
    size = attention.CONTEXT_CELLS

    def rows(table: np.ndarray) -> Iterator[pa.RecordBatch]:
        parts = []
        for two, part in enumerate(table.reshape(-1, size)):
            places = np.flatnonzero(part)
            if len(places):
                parts.append((two, places.astype(np.uint32).tobytes(), part[places].tobytes()))
        for k in range(0, len(parts), SENT_CONTEXTS):
            two, places, n = zip(*parts[k : k + SENT_CONTEXTS])
            columns = [pa.array(two, pa.int64()), pa.array(places, pa.binary()), pa.array(n, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["two", "places", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        table, counted = np.zeros((attention.CLASSES + 1) * size, np.uint32), 0
        for found, n in _held(batches, lambda ids: attention.class_cells(ids, classes.value).astype(np.int32)):
            if counted + n.sum() > MOST_COUNTED:
                yield from rows(table)
                table[:], counted = 0, 0
            table[found] += n.astype(np.uint32)
            counted += n.sum()
        yield from rows(table)

    return run


def _sum_class_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells and counts of rows of :func:`_count_class_cells`, which come in order of ``two``."""
    size, last, table = attention.CONTEXT_CELLS, -1, np.zeros(attention.CONTEXT_CELLS, np.int64)

    def cells() -> Iterator[pa.RecordBatch]:
        found = np.flatnonzero(table)
        return _sliced([last * size + found, table[found]], ["cell", "n"])

    for batch in batches:
        for two, places, n in zip(batch.column("two").to_pylist(), batch.column("places"), batch.column("n")):
            if two != last:
                yield from cells()
                last = two
                table[:] = 0
            table[np.frombuffer(places.as_buffer(), np.uint32)] += np.frombuffer(n.as_buffer(), np.uint32)
    yield from cells()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two number columns as one row of bytes per batch."""
    for batch in batches:
        if batch.num_rows:
            packed = [pa.array([np.ascontiguousarray(c.to_numpy()).tobytes()], pa.binary()) for c in batch.columns]
            yield pa.RecordBatch.from_arrays(packed, ["a", "b"])


def packed(df: DataFrame) -> list[list[np.ndarray]]:
    """Two long columns of a table of bounded size, on the driver, in the parts they came in."""
    found = df.mapInArrow(_packed, "a binary, b binary").toArrow()
    return [[np.frombuffer(part.as_buffer(), np.int64) for part in found.column(k)] for k in (0, 1)]


def gathered(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`packed`, in one part."""
    a, b = (np.concatenate([np.zeros(0, np.int64), *parts]) for parts in packed(df))
    return a, b


def count(encoded: DataFrame) -> tuple[attention.Cells, DataFrame]:
    """Counts over all training rows of ``encoded``: of classes, held, and of ids, as a stored table."""
    training = encoded.filter("NOT held_out").select("ids")
    ids, n = gathered(training.mapInArrow(_count_ids, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")))
    single = np.zeros(VOCABULARY)
    single[ids] = n
    classes = attention.classes_of(single)
    held = encoded.sparkSession.sparkContext.broadcast(classes)

    of_classes = training.mapInArrow(_count_class_cells(held), "two long, places binary, n binary")
    of_classes = of_classes.repartition("two").sortWithinPartitions("two").mapInArrow(_sum_class_cells, "cell long, n long")
    of_classes = stored(of_classes, "class-cells")  # packed at once, each task would take two Python workers
    of_ids = training.mapInArrow(_count_id_cells(held), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    return attention.Cells(single, attention.table_of(*packed(of_classes)), classes), stored(of_ids, "follower-cells")


def _document_cells(classes):
    """Distinct cells of each row, and how often they stand there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for row, ids in zip(batch.column("row").to_pylist(), _arrays(batch)):
                cell, n = np.unique(attention.id_cells(ids, classes.value), return_counts=True)
                parts.append((np.full(len(cell), row, np.int64), cell, n))
            if parts:
                yield from _sliced([np.concatenate(c) for c in zip(*parts)], ["row", "cell", "n"])

    return run


def within_classes(encoded: DataFrame, cells: DataFrame, counts: attention.Cells) -> DataFrame:
    """``within`` by ``row``: log10 of the shares of ids in their classes, by shuffles.

    An id's share behind the two ids before leans on that behind the one before, and this on
    the share it has in its class, each as much as the context has followers of the class. The
    share of each distinct cell is found once and then meets the rows.
    """
    spark, before = encoded.sparkSession, VOCABULARY + 1
    held = spark.sparkContext.broadcast(counts.classes)
    total = np.bincount(counts.classes, counts.single + 0.5, minlength=attention.CLASSES)
    alone = (counts.single + 0.5) / total[counts.classes]
    ids = pa.table({"id": np.arange(VOCABULARY), "kind": counts.classes, "alone": alone})
    ids = F.broadcast(spark.createDataFrame(ids).filter(F.col("kind") >= attention.OWN_CLASSES))

    def parted(df: DataFrame) -> DataFrame:
        df = df.withColumn("id", F.col("cell") % VOCABULARY).withColumn("context", F.expr(f"cell div {VOCABULARY}"))
        return df.withColumn("one", F.col("context") % before).join(ids, "id")

    def share(n: str, totals: str, kinds: str, less) -> Column:
        kinds = F.coalesce(F.col(kinds), F.lit(1))
        return (F.coalesce(F.col(n), F.lit(0)) + kinds * less) / (F.coalesce(F.col(totals), F.lit(0)) + kinds)

    known = parted(cells)
    ones = known.groupBy("one", "id", "kind").agg(F.sum("n").alias("n1"))
    total1 = ones.groupBy("one", "kind").agg(F.sum("n1").alias("t1"), F.count(F.lit(1)).alias("k1"))
    total2 = known.groupBy("context", "kind").agg(F.sum("n").alias("t2"), F.count(F.lit(1)).alias("k2"))
    rows = encoded.select("row", "ids").dropDuplicates(["row"])
    own = stored(rows.mapInArrow(_document_cells(held), "row long, cell long, n long"), "document-cells")
    wanted = parted(own.select("cell").distinct())
    wanted = wanted.join(cells.withColumnRenamed("n", "n2"), "cell", "left").join(total2, ["context", "kind"], "left")
    wanted = wanted.join(ones.drop("kind"), ["one", "id"], "left").join(total1, ["one", "kind"], "left")
    less = share("n1", "t1", "k1", F.col("alone"))
    shares = stored(wanted.select("cell", F.log10(share("n2", "t2", "k2", less)).alias("log")), "cell-shares")
    return own.join(shares, "cell").groupBy("row").agg(F.sum(F.col("n") * F.col("log")).alias("within"))


def schedule(tokens: float) -> tuple[int, int]:
    """How many rounds there are, and each how many windows one is taken in a round."""
    windows = tokens / attention.STRIDE
    every = int(min(TRAIN_EVERY, max(1, FEWEST_ROUNDS * windows // TRAIN_WINDOWS)))
    wanted = -(-TRAIN_WINDOWS * every // max(1, windows))
    return int(min(MOST_ROUNDS, max(FEWEST_ROUNDS, wanted))), every


def turns(rounds: int, every: int, turn: int) -> tuple[int, int]:
    """The first window of ``every`` that a round takes and how many more follow it: all rounds take all."""
    share = -(-every // rounds)
    return turn * share % every, share


def _train(cells, weights: np.ndarray, every: int, first: int, share: int, rate: float):
    """One pass over windows of the task's texts; the weights times the windows they have seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        p, seen, texts, size = attention.unpacked(weights), 0, [], 0

        def learn() -> None:
            nonlocal p, seen
            p, windows = attention.train(p, texts, cells.value, every, first, rate, share)
            seen += windows
            released()

        for batch in batches:
            for ids in _arrays(batch):
                texts.append(ids.astype(np.uint16))
                size += len(ids)
                if size >= TRAIN_IDS:
                    learn()
                    texts, size = [], 0
        if texts:
            learn()
        if seen:
            yield _summed([(seen, attention.packed(p).astype(np.float64) * seen)])

    return run


def _summed(parts) -> pa.RecordBatch:
    seen = sum(n for n, _ in parts)
    row = sum(w for _, w in parts)
    return pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([row.tobytes()], pa.binary())], ["seen", "weights"])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for n, row in zip(batch.column("seen").to_pylist(), batch.column("weights").to_pylist()):
            part = (n, np.frombuffer(row, np.float64))
            total = part if total is None else (total[0] + n, total[1] + part[1])
    if total is not None:
        yield _summed([total])


def fit(encoded: DataFrame, cells) -> attention.Parameters:
    """Weights averaged over the tasks that hold the training ids; ``cells`` is a broadcast."""
    training, schema = encoded.filter("NOT held_out").select("ids"), "seen long, weights binary"
    weights = attention.packed(attention.initial())
    rounds, every = schedule(cells.value.single.sum())
    for turn in range(rounds):
        rate = attention.RATE * 0.1 ** (turn / (rounds - 1))
        parts = training.mapInArrow(_train(cells, weights, every, *turns(rounds, every, turn), rate), schema)
        # One row a task, summed in as many tasks as the root of their number before the driver sees them.
        groups = max(1, int(training.rdd.getNumPartitions() ** 0.5))
        found = parts.repartition(groups).mapInArrow(_sum, schema).collect()
        if found:
            weights = sum(np.frombuffer(bytes(r.weights), np.float64) for r in found) / sum(r.seen for r in found)
    return attention.unpacked(weights)


def _score(cells, parameters: attention.Parameters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for batch in batches:
            found, texts, size = [], [], 0
            for ids in _arrays(batch):
                if texts and size + len(ids) > SCORED_IDS:
                    found.append(attention.score(parameters, cells.value.counts(), texts))
                    texts, size = [], 0
                texts.append(ids)
                size += len(ids)
            found.append(attention.score(parameters, cells.value.counts(), texts))
            kept = [n for n in batch.schema.names if n != "ids"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(np.concatenate(found))], [*kept, "score"])

    return run


def _word_hashes(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of texts: rows, distinct hashes of words, and per word its number and text."""
    for low, high in wordbytes.chunks(texts):
        words = wordbytes.Words([t.lower() for t in texts[low:high]], WORD_BYTES)
        distinct, place = np.unique(words.hashes().view(np.int64), return_inverse=True)
        yield low, high, distinct, place, words


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of words and their counts, combined within a portion; text ends included."""
    for texts, _ in (x for batch in batches for x in wordbytes.portions(batch)):
        parts = [(d, np.bincount(place, minlength=len(d))) for _, _, d, place, _ in _word_hashes(texts)]
        hashes, place = np.unique(np.concatenate([d for d, _ in parts]), return_inverse=True)
        n = np.bincount(place, np.concatenate([c for _, c in parts]), minlength=len(hashes)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(n)], ["word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([END_HASH]), pa.array([np.int64(len(texts))])], ["word", "n"])


def _base_scores(counts, total: int, distinct: int):
    """Base scores by counts held in the task."""
    floor = np.log10(total + 0.5 * (distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = counts.value
        end = n[np.searchsorted(words, END_HASH)] if total else 0
        for texts, batch in (x for batch in batches for x in wordbytes.portions(batch)):
            size, known, score = [], [], []
            for low, high, hashes, place, found in _word_hashes(texts):
                at = np.minimum(np.searchsorted(words, hashes), max(0, len(words) - 1))
                c = np.where(words[at] == hashes, n[at], 0) if len(words) else np.zeros(len(hashes), np.int64)
                logs = (np.log10(c + 0.5) - floor)[place]
                size.append(found.count + 1)
                known.append(np.bincount(found.doc, (c > 0)[place], minlength=high - low).astype(np.int64) + int(end > 0))
                score.append(np.bincount(found.doc, logs, minlength=high - low) + np.log10(end + 0.5) - floor)
            kept = [n for n in batch.schema.names if n != "text"]
            columns = [pa.array(np.concatenate(x)) for x in (size, known, score)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in kept), *columns], [*kept, "n_tokens", "n_known", "base_score"]
            )

    return run


def _document_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each row and how often they stand there, the end included."""
    for batch in batches:
        for texts, part in wordbytes.portions(batch):
            rows = part.column("row").to_numpy()
            for low, high, hashes, place, found in _word_hashes(texts):
                cells, n = np.unique(found.doc * len(hashes) + place, return_counts=True)
                doc = np.concatenate([cells // max(1, len(hashes)), np.arange(high - low)])
                word = np.concatenate([hashes[cells % max(1, len(hashes))], np.full(high - low, END_HASH)])
                n = np.concatenate([n, np.ones(high - low, np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(rows[low + doc]), pa.array(word), pa.array(n)], ["row", "word", "n"])


def _joined_base(rows: DataFrame, counts: DataFrame, total: int, distinct: int) -> DataFrame:
    """Base scores by a shuffle: words of all rows meet the counts."""
    words = rows.select("row", "text").mapInArrow(_document_words, "row long, word long, n long")
    c = F.coalesce(F.col("c"), F.lit(0))
    floor = float(np.log10(total + 0.5 * (distinct + 1)))
    return (
        words.join(counts.withColumnRenamed("n", "c"), "word", "left")
        .groupBy("row")
        .agg(
            F.sum("n").alias("n_tokens"),
            F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("n_known"),
            F.sum(F.col("n") * (F.log10(c + 0.5) - floor)).alias("base_score"),
        )
    )


def base_scores(texts: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> tuple[DataFrame, int]:
    """Stored base scores by ``row``, and the number of training tokens.

    The scores are stored so that tasks need not hold the word counts beside the other model.
    """
    counts = texts.filter("NOT held_out").select("text").mapInArrow(_count_words, "word long, n long")
    counts = stored(counts.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    distinct, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if distinct > broadcast_words:
        return stored(_joined_base(texts.dropDuplicates(["row"]), counts, total, distinct), "base-scores"), total
    words, n = gathered(counts)
    order = np.argsort(words)
    held = texts.sparkSession.sparkContext.broadcast((words[order], n[order]))
    base = texts.select("row", "text").mapInArrow(
        _base_scores(held, total, distinct), "row long, n_tokens long, n_known long, base_score double"
    )
    base = stored(base.dropDuplicates(["row"]), "base-scores")
    held.destroy()
    return base, total


def score_documents(
    documents: DataFrame,
    tokenizer: str = TOKENIZER,
    broadcast_words: int = BROADCAST_WORDS,
) -> DataFrame:
    """One row per document: base and model scores with the counts behind them."""
    spark = documents.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = documents.select("doc_id", held_out().alias("held_out"), text.alias("text"))
    row = F.xxhash64("doc_id", "text")
    texts = texts.withColumn("row", row)

    base, total = base_scores(texts, broadcast_words)
    encoded = stored(texts.mapInArrow(_encode(tokenizer), f"{_ddl(texts, 'text')}, ids binary"), "subword-ids")
    counts, table = count(encoded)
    cells = spark.sparkContext.broadcast(counts)
    scored = encoded.mapInArrow(_score(cells, fit(encoded, cells)), f"{_ddl(encoded, 'ids')}, score double")
    scored = scored.join(within_classes(encoded, table, counts), "row", "left")
    scored = scored.withColumn("score", F.col("score") + F.coalesce("within", F.lit(0.0))).drop("within")
    return scored.join(base, "row").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"
    )


def _ddl(df: DataFrame, *without: str) -> str:
    return ", ".join(f"{n} {t}" for n, t in df.dtypes if n not in without)
