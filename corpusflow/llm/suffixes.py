"""Exact substring deduplication: a byte covered by a SPAN-byte string that starts earlier goes.

1. Anchors. Of the GRAM-byte hashes in each SPAN-byte string, the least (the first such)
   owns the string; equal strings have equal owners at equal offsets. Consecutive strings
   of one owner are one run, about SPAN - GRAM bytes apart in running text. A run is known
   by its owner's hash and the hash of all its bytes.
2. Runs meet by owner. Of equal runs all but the earliest are repeats as a whole; within a
   portion of a batch this is decided before the shuffle, so a passage that stands in any
   share of the documents comes from each portion once. An owner with one distinct run is done.
3. The bytes of the distinct runs of the other owners are sharded by owner, and the suffixes
   that begin a string are sorted by induction (see ``induced``). Neighbours with a common
   prefix of SPAN bytes are one class; all but its earliest member are repeats. An owner whose
   distinct runs are more than SHARD_BYTES is no shard: its strings are dealt out by the hash
   of all their bytes, met within each portion first, and compared in the order of that hash.
4. The spans of the repeats are merged per document and cut out of the text.

Equality in 2 is that of two 64-bit hashes over at most 2 x SPAN bytes; in 3 it is compared
byte for byte, or by 128 bits of BLAKE2 for the strings of a large owner. The sides that meet the texts again are small tables of counted size
(broadcast) or are joined by shuffle.

Rows: a null or empty text has no bytes. Documents are ordered by id, null last; rows with
one id and different texts by the hash of their text. Equal rows are one document and get
the same result. An empty table gives no rows. Only doc_id and text are used.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import induced, wordbytes
from corpusflow.llm.rows import beside, numbered
from corpusflow.llm.store import join_few, stored

SPAN = 100
GRAM = 24
SHARD_BYTES = 1 << 20
BROADCAST_OWNERS = 1_000_000
EVERY = np.ones(256, bool)


def _owners(data: np.ndarray, running: np.ndarray) -> np.ndarray:
    """For each SPAN-byte string of ``data``, where its owner begins."""
    m = len(data) - GRAM + 1
    starts = np.arange(m)
    keys = (wordbytes.run_hashes(running, starts, starts + GRAM) & np.uint64(0xFFFFFFFF00000000)) | starts.astype(np.uint64)
    width = SPAN - GRAM + 1
    least, covered = keys, 1
    while covered * 2 <= width:
        least = np.minimum(least[:-covered], least[covered:])
        covered *= 2
    if covered < width:
        least = np.minimum(least[: len(least) - (width - covered)], least[width - covered :])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def runs_of(texts: list[bytes], keys: np.ndarray) -> list[np.ndarray]:
    """Runs of some texts: owner, run hash, key, place of the owner, first and last string."""
    found = []
    for low, high in wordbytes.chunks(texts):
        buffer = b"".join(texts[low:high])
        lengths = np.array([len(t) for t in texts[low:high]])
        if lengths.sum() < SPAN:
            continue
        data = np.frombuffer(buffer, np.uint8).astype(np.uint64) + np.uint64(1)
        running = wordbytes.sums(data)
        owners = _owners(data, running)
        begins = np.cumsum(lengths) - lengths
        doc = np.repeat(np.arange(high - low), lengths)
        starts = np.flatnonzero(doc[: len(owners)] == doc[SPAN - 1 : SPAN - 1 + len(owners)])
        if not len(starts):
            continue
        own = owners[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)
        first, at = starts[new], own[new]
        last = starts[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]
        grams = wordbytes.run_hashes(running, at, at + GRAM)
        whole = wordbytes.run_hashes(running, first, last + SPAN)
        whole = wordbytes.mixed(whole + (at - first).astype(np.uint64) * np.uint64(wordbytes.BASE))
        d = doc[first]
        found.append(
            [grams.view(np.int64), whole.view(np.int64), keys[low + d], at - begins[d], first - begins[d], last - begins[d]]
        )
    if not found:
        return [np.zeros(0, np.int64)] * 6
    return [np.concatenate(columns) for columns in zip(*found)]


RUN_SCHEMA = "owner long, run long, key long, at long, first long, last long, repeat boolean"
RUN_NAMES = ["owner", "run", "key", "at", "first", "last", "repeat"]


def _emit_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of each portion. Equal ones but the earliest are marked and dealt out by place."""
    for texts, batch in itertools.chain.from_iterable(map(wordbytes.portions, batches)):
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        owner, run, key, at, first, last = runs_of(texts, keys)
        order = np.lexsort((at, key, run, owner))
        owner, run, key, at, first, last = (x[order] for x in (owner, run, key, at, first, last))
        repeat = np.zeros(len(owner), bool)
        repeat[1:] = (owner[1:] == owner[:-1]) & (run[1:] == run[:-1])
        spread = wordbytes.mixed(key.view(np.uint64) + at.view(np.uint64) * np.uint64(wordbytes.BASE)).view(np.int64)
        owner = np.where(repeat, spread, owner)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (owner, run, key, at, first, last, repeat)], RUN_NAMES)


def _meet_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of runs in order of owner, run and place: repeats, and distinct runs of shared owners.

    The first run of an owner is held until a second one shows that it is shared.
    """
    last_owner, last_run, held, shared = None, None, None, False
    for batch in batches:
        columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in RUN_NAMES]
        settled = columns[6]
        out = [[x[settled] for x in columns]]
        owner, run = columns[0][~settled], columns[1][~settled]
        rest = [x[~settled] for x in columns]
        if len(owner):
            new_owner, new_run = np.ones(len(owner), bool), np.ones(len(owner), bool)
            new_owner[1:] = owner[1:] != owner[:-1]
            new_run[1:] = new_owner[1:] | (run[1:] != run[:-1])
            if last_owner is not None:
                new_owner[0] = owner[0] != last_owner
                new_run[0] = new_owner[0] or run[0] != last_run
            again = [x[~new_run] for x in rest]
            again[6] = np.ones(len(again[0]), bool)
            out.append(again)
            distinct = [x[new_run] for x in rest]
            distinct[6] = np.zeros(len(distinct[0]), bool)
            joins = ~new_owner[new_run]  # with the distinct run before it
            if held is not None and len(joins):
                if joins[0] and not shared:
                    out.append(held)
                    shared = True
            if len(joins):
                beside = joins.copy()
                beside[:-1] |= joins[1:]
                tail_shared = bool(beside[-1])
                out.append([x[beside] for x in distinct])
                held, shared = [x[-1:] for x in distinct], tail_shared
            last_owner, last_run = owner[-1], run[-1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x)) for x in zip(*out)], RUN_NAMES
        )


def _emit_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the listed runs of each text."""
    for batch in batches:
        texts = wordbytes.texts_of(batch.column("text"))
        for key, text, runs in zip(batch.column("key").to_pylist(), texts, batch.column("runs").to_pylist()):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["owner"] for r in runs], pa.int64()),
                    pa.array([key] * len(runs), pa.int64()),
                    pa.array([r["first"] for r in runs], pa.int64()),
                    pa.array([text[r["first"] : r["last"] + SPAN] for r in runs], pa.binary()),
                ],
                ["owner", "key", "first", "bytes"],
            )


def repeats_among(keys: np.ndarray, firsts: np.ndarray, pieces: list[bytes]) -> list[np.ndarray]:
    """Strings in some pieces that also start earlier: spans of key, start and end."""
    lengths = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"\0".join(pieces) + b"\0" * 8, np.uint8)
    begins = np.cumsum(lengths + 1) - lengths - 1
    text = np.zeros(len(data) - 7, np.int64)
    text[:-1] = data[:-8].astype(np.int64) + 2
    text[begins[1:] - 1] = 1
    strings = lengths - SPAN + 1
    piece = np.repeat(np.arange(len(pieces)), strings)
    inside = np.arange(len(piece)) - np.repeat(np.cumsum(strings) - strings, strings)
    wanted = begins[piece] + inside
    order = np.argsort(induced.suffix_ranks(text, wanted))
    near = induced.common_prefixes(data, wanted[order[:-1]], wanted[order[1:]], SPAN)
    group = np.concatenate([[0], np.cumsum(near < SPAN)])
    key, start = keys[piece[order]], firsts[piece[order]] + inside[order]
    by_place = np.lexsort((start, key, group))
    later = np.zeros(len(group), bool)
    later[1:] = group[by_place][1:] == group[by_place][:-1]
    hit = np.zeros(len(piece), bool)
    hit[order[by_place[later]]] = True
    at = np.flatnonzero(hit)
    if not len(at):
        return [np.zeros(0, np.int64)] * 3
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (piece[at[1:]] != piece[at[:-1]])
    ends = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    begin = at[new]
    return [keys[piece[begin]], firsts[piece[begin]] + inside[begin], firsts[piece[ends]] + inside[ends] + SPAN]


def _sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated spans among runs in order of owner, whole owners together."""
    held: list[tuple] = []
    size = 0

    def solved() -> pa.RecordBatch:
        spans = repeats_among(np.array([h[1] for h in held]), np.array([h[2] for h in held]), [h[3] for h in held])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in spans], ["key", "start", "end"])

    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in ("owner", "key", "first", "bytes"))):
            if size >= SHARD_BYTES and row[0] != held[-1][0]:
                yield solved()
                held, size = [], 0
            held.append(row)
            size += len(row[3]) + 1
    if held:
        yield solved()


STRING_SCHEMA = "hash long, hash2 long, key long, start long, end long, repeat boolean"
STRING_NAMES = ["hash", "hash2", "key", "start", "end", "repeat"]


def _joined_starts(key: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """Strings that begin one after the other, in order of key and start, as spans."""
    order = np.lexsort((start, key))
    key, start = key[order], start[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (start[1:] > start[:-1] + 1)
    last = np.append(np.flatnonzero(new)[1:] - 1, len(key) - 1) if len(key) else np.zeros(0, np.int64)
    return [key[new], start[new], start[last] + SPAN]


def _emit_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of the listed runs of each portion: the first of equal ones, the others as spans."""
    for texts, batch in itertools.chain.from_iterable(map(wordbytes.portions, batches)):
        digests, keys, starts = [], [], []
        for key, text, runs in zip(batch.column("key").to_pylist(), texts, batch.column("runs").to_pylist()):
            for r in runs:
                places = range(r["first"], r["last"] + 1)
                digests.append(b"".join(hashlib.blake2b(text[a : a + SPAN], digest_size=16).digest() for a in places))
                keys.append(np.full(len(places), key, np.int64))
                starts.append(np.array(places, np.int64))
        one, two = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2).T
        key, start = np.concatenate(keys), np.concatenate(starts)
        order = np.lexsort((start, key, two, one))
        one, two, key, start = (x[order] for x in (one, two, key, start))
        again = np.zeros(len(one), bool)
        again[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
        first = [x[~again] for x in (one, two, key, start)]
        yield pa.RecordBatch.from_arrays(
            [*map(pa.array, first), pa.array(first[3] + SPAN), pa.array(np.zeros(len(first[0]), bool))], STRING_NAMES
        )
        key, start, end = _joined_starts(key[again], start[again])
        dealt = wordbytes.mixed(key.view(np.uint64) + start.view(np.uint64) * np.uint64(wordbytes.BASE)).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [*map(pa.array, (dealt, dealt, key, start, end)), pa.array(np.ones(len(key), bool))], STRING_NAMES
        )


def _meet_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated spans among strings in order of hash, key and start; only the last one is held."""
    before = None
    for batch in batches:
        one, two, key, start, end, repeat = (batch.column(n).to_numpy(zero_copy_only=False) for n in STRING_NAMES)
        yield pa.RecordBatch.from_arrays([pa.array(x[repeat]) for x in (key, start, end)], ["key", "start", "end"])
        one, two, key, start = (x[~repeat] for x in (one, two, key, start))
        if len(one):
            again = np.zeros(len(one), bool)
            again[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
            again[0] = before == (one[0], two[0])
            before = (one[-1], two[-1])
            spans = _joined_starts(key[again], start[again])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in spans], ["key", "start", "end"])


PLACES = 1 << 40  # more than any place in a text


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted spans of each key with those that touch or overlap made one."""
    for batch in batches:
        lists = batch.column("spans")
        flat = lists.flatten()
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        start, end = (flat.field(k).to_numpy(zero_copy_only=False) + row * PLACES for k in (0, 1))
        reach = np.maximum.accumulate(end)
        new = np.ones(len(row), bool)
        new[1:] = start[1:] > reach[:-1]
        last = np.append(np.flatnonzero(new)[1:] - 1, len(row) - 1)
        sizes = np.bincount(row[new], minlength=len(lists))
        spans = pa.StructArray.from_arrays(
            [pa.array(start[new] % PLACES), pa.array(reach[last] - row[last] * PLACES)], ["start", "end"]
        )
        offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(offsets, spans)], ["key", "spans"])


def repeated_spans(texts: DataFrame) -> DataFrame:
    """``key`` and ``spans`` (start, end; sorted, apart) from ``key`` and ``text``."""
    texts = texts.select("key", "text")
    runs = texts.mapInArrow(_emit_runs, RUN_SCHEMA)
    runs = runs.repartition("owner").sortWithinPartitions("owner", "run", "key", "at")
    met = stored(runs.mapInArrow(_meet_runs, RUN_SCHEMA), "suffix-runs")
    distinct = met.filter("NOT repeat")
    size = F.sum(F.col("last") - F.col("first") + SPAN + 1)
    large = stored(distinct.groupBy("owner").agg(size.alias("size")).filter(F.col("size") > SHARD_BYTES), "large-owners")
    owners = large.count()

    def listed(how: str, label: str) -> DataFrame:
        some = join_few(distinct, large, ["owner"], owners, BROADCAST_OWNERS, how) if owners else distinct
        lists = some.groupBy("key").agg(F.collect_list(F.struct("owner", "first", "last")).alias("runs"))
        return beside(texts, stored(lists, label), "runs", "inner")

    pieces = listed("left_anti", "suffix-lists").mapInArrow(
        _emit_bytes, "owner long, key long, first long, bytes binary"
    )
    sharded = pieces.repartition("owner").sortWithinPartitions("owner")
    spans = sharded.mapInArrow(_sort_shards, "key long, start long, end long")
    if owners:
        strings = listed("left_semi", "large-lists").mapInArrow(_emit_strings, STRING_SCHEMA)
        strings = strings.repartition("hash").sortWithinPartitions("hash", "hash2", "key", "start")
        spans = spans.union(strings.mapInArrow(_meet_strings, "key long, start long, end long"))
    spans = spans.union(met.filter("repeat").select("key", F.col("first").alias("start"), (F.col("last") + SPAN).alias("end")))
    lists = spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    return lists.mapInArrow(_merge, "key long, spans array<struct<start:long,end:long>>")


def _cut(text: bytes, spans: list[dict]) -> bytes:
    edges = [0, *(x for span in spans for x in (span["start"], span["end"])), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = wordbytes.texts_of(batch.column("text"))
        spans = [s or [] for s in batch.column("spans").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("rows"),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([sum(x["end"] - x["start"] for x in m) for m in spans], pa.int64()),
                pa.array([len(m) for m in spans], pa.int64()),
                pa.array([hashlib.sha256(_cut(t, m)).hexdigest() for t, m in zip(texts, spans)], pa.string()),
            ],
            ["doc_id", "rows", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def suffix_digest(documents: DataFrame) -> DataFrame:
    texts = numbered(documents)
    spans = stored(repeated_spans(texts), "suffix-spans")
    kind = dict(texts.dtypes)["doc_id"]
    told = beside(texts, spans, "spans", "left").mapInArrow(
        _digest, f"doc_id {kind}, rows long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
    return told.select("*", F.explode(F.sequence(F.lit(1), F.col("rows")))).drop("col", "rows")
