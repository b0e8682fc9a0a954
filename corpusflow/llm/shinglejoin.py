"""Documents whose shingle sets are alike: a Jaccard join filtered under several token orders.

A document's set are its distinct 5-word shingles as 64-bit hashes. Under any order of all
shingles two sets of similarity 0.8 share one among their first n - ceil(0.8 n) + 1; pairs have
to do so under each of three orders before they are verified:

* rare shingles first, equal counts by hash;
* rare shingles first, equal counts by hash downwards;
* by hash alone.

Equal sets are one class and verified once. Whether a shingle stands in one class only is
found first, by shuffling packed hashes; a class with so many such shingles that they fill its
prefix has no partner, and most leave here. Documents that are repeated inside a batch are
told beforehand, so a frequent shingle crosses the shuffle once a batch.

Pairs are not listed inside a file (the classes with one shingle in their prefix). Each file
is compared with its least class, then, where several components are left, with a class drawn
for the file, in several rounds, in which each class verifies one likely partner; of what is
left all likely pairs of different components are verified. So a group of near copies costs
as much as it has members, and no link is lost.

Wherever classes meet, a parity signature is compared as well: each shingle turns one of 1,024
bits, so two sets differ in at least as many shingles as their signatures in bits, and sets of
similarity 0.8 differ in at most a ninth of their summed sizes.

Rows: a text without words, or null, has no set and is its own component; rows are judged by
their text, also repeated ones; a null id names a component only if there is no other. Long
texts are read in pieces that overlap by four words. An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import graph, wordbytes
from corpusflow.llm.store import in_tasks, join_few, stored

SHINGLE = 5
NEED, OF = 80, 100
BUCKET_TOKENS = 2_000_000
PIECE_BYTES = 4 << 20
BROADCAST_ROWS = 500_000
BROADCAST_SIGNED = 100_000  # rows of a signature and a few numbers: 15 MB
PARITY = 16  # longs of a signature
DRAWS = 3  # rounds in which a file's classes are compared with one drawn for it
ROWS_A_TASK = 200_000  # of narrow tables, which the rounds read again and again
MANY = 0xFFFF  # stands for the documents of a shingle that is repeated inside a batch
WORD_BYTES = wordbytes.byte_class([(0x20, 0x20), (0x09, 0x0D)])
BATCH_ROWS = 10_000


def _long_set(text: bytes) -> np.ndarray:
    """The set of a long text, read in pieces that share SHINGLE - 1 words."""
    found, carried, at = [], b"", 0
    while at < len(text):
        end = at + PIECE_BYTES
        while end < len(text) and WORD_BYTES[text[end]]:
            end += 1
        piece = carried + b" " + text[at:end]
        words = wordbytes.Words([piece], WORD_BYTES)
        found.append(np.unique(wordbytes.gram_hashes(words.hashes(), SHINGLE)))
        carried = words.joined(max(0, len(words.starts) - SHINGLE + 1), SHINGLE - 1)
        at = end
    return np.unique(np.concatenate(found))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles."""
    out = [np.zeros(0, np.uint64)] * len(texts)
    short = []
    for k, text in enumerate(texts):
        if len(text) <= PIECE_BYTES:
            short.append(k)
        else:
            out[k] = _long_set(text.lower())
    for first, end in wordbytes.chunks([texts[k] for k in short]):
        rows = short[first:end]
        words = wordbytes.Words([texts[k].lower() for k in rows], WORD_BYTES)
        running = wordbytes.sums(words.hashes())
        stops = np.cumsum(words.count)
        for k, stop, n in zip(rows, stops, words.count):
            if n:
                starts = np.arange(stop - n, stop - min(n, SHINGLE) + 1)
                out[k] = np.unique(wordbytes.run_hashes(running, starts, starts + min(n, SHINGLE)))
    for k, text in enumerate(texts):  # long texts of few words
        if not len(out[k]) and text.split(None, 1):
            words = wordbytes.Words([text.lower()], WORD_BYTES)
            n = len(words.starts)
            out[k] = wordbytes.run_hashes(wordbytes.sums(words.hashes()), np.array([0]), np.array([n]))
    return out


def set_class(tokens: np.ndarray) -> bytes | None:
    """128 bits that stand for a set; null for the empty one."""
    if not len(tokens):
        return None
    first, second = wordbytes.mixed(tokens), wordbytes.mixed(tokens ^ np.uint64(0x9E3779B97F4A7C15))
    return np.array([first.sum(dtype=np.uint64), second.sum(dtype=np.uint64)]).tobytes()


class _Batch:
    """The classes of some texts, their shingles in order, and which are repeated here."""

    def __init__(self, texts: list[bytes]):
        self.sets = shingle_sets(texts)
        self.classes = [set_class(s) for s in self.sets]
        place: dict[bytes, int] = {}
        self.index = [-1 if c is None else place.setdefault(c, len(place)) for c in self.classes]
        held = [self.sets[k] for k in self._firsts(len(place))]
        tokens = np.concatenate(held) if held else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(held)), [len(s) for s in held]).astype(np.int64)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[order], owner[order]
        same = self.tokens[1:] == self.tokens[:-1]
        self.repeated = np.zeros(len(tokens), bool)
        self.repeated[1:] |= same
        self.repeated[:-1] |= same
        self.local = np.bincount(self.owner[self.repeated], minlength=len(held))
        joined = np.frombuffer(b"".join(place) or bytes(8), np.uint64)
        steps = np.arange(1, len(joined) + 1, dtype=np.uint64)
        self.name = int(wordbytes.mixed(joined * (steps * np.uint64(2) + np.uint64(1))).sum(dtype=np.uint64).view(np.int64))

    def _firsts(self, n: int) -> list[int]:
        firsts = [-1] * n
        for k, at in enumerate(self.index):
            if at >= 0 and firsts[at] < 0:
                firsts[at] = k
        return firsts


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Batch, pa.RecordBatch]]:
    for batch in batches:
        for texts, rows in wordbytes.portions(batch):
            for at in range(0, len(texts), BATCH_ROWS):
                yield _Batch(texts[at : at + BATCH_ROWS]), rows.slice(at, BATCH_ROWS)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for found, rows in _batches(batches):
        columns = [
            rows.column("doc_id"),
            pa.array([len(s) for s in found.sets], pa.int64()),
            pa.array(found.classes, pa.binary()),
            pa.array([found.name] * len(found.sets), pa.int64()),
            pa.array(found.index, pa.int32()),
            pa.array([int(found.local[i]) if i >= 0 else 0 for i in found.index], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "cls", "batch", "place", "local"])


def _packed(buckets: int):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, _ in _batches(batches):
            first = np.ones(len(found.tokens), bool)
            first[1:] = found.tokens[1:] != found.tokens[:-1]
            tokens = found.tokens[first]
            places = np.where(found.repeated, MANY, found.owner)[first].astype(np.uint16)
            bucket = ((tokens >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            used = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
            columns = [
                pa.array(used, pa.int32()),
                pa.array([found.name] * len(used), pa.int64()),
                pa.array([tokens[cuts[b] : cuts[b + 1]].tobytes() for b in used], pa.binary()),
                pa.array([places[cuts[b] : cuts[b + 1]].tobytes() for b in used], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "batch", "tokens", "places"])

    return packed


def _met(rows: pa.Table) -> pa.Table:
    """One bucket: for each batch the places of its shingles that other batches hold, too."""
    blobs = [np.frombuffer(t, np.uint64) for t in rows.column("tokens").to_pylist()]
    places = np.concatenate([np.frombuffer(p, np.uint16) for p in rows.column("places").to_pylist()])
    tokens = np.concatenate(blobs)
    order = np.argsort(tokens, kind="stable")
    same = tokens[order][1:] == tokens[order][:-1]
    shared = np.zeros(len(tokens), bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    shared &= places != MANY
    cuts = np.cumsum([0] + [len(b) for b in blobs])
    out = [places[a:b][shared[a:b]].tobytes() for a, b in zip(cuts, cuts[1:])]
    return pa.table({"batch": rows.column("batch"), "places": pa.array(out, pa.binary())})


def _summed(rows: pa.Table) -> pa.Table:
    """One batch: how many shingles each place shares with other batches."""
    places = np.frombuffer(b"".join(rows.column("places").to_pylist()), np.uint16)
    shared = np.bincount(places, minlength=1)
    return pa.table({"batch": rows.column("batch")[:1], "shared": pa.array([shared.tolist()], pa.list_(pa.int64()))})


def _prefix(n: Column) -> Column:
    return (n - F.ceil(n * NEED / OF) + 1).cast("int")


def possible(documents: DataFrame, described: DataFrame) -> DataFrame:
    """Rows of ``described`` whose prefix is not filled by shingles of their own.

    A batch that another run cut differently has no counts and stays as it is.
    """
    total = described.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(1, -(-total // BUCKET_TOKENS))
    blobs = documents.mapInArrow(_packed(buckets), "bucket int, batch long, tokens binary, places binary")
    met = blobs.groupBy("bucket").applyInArrow(_met, "batch long, places binary")
    counts = met.groupBy("batch").applyInArrow(_summed, "batch long, shared array<long>")
    shared = F.coalesce(F.get("shared", F.col("place")), F.lit(0)) + F.col("local")
    alone = F.col("n") - F.when(F.col("shared").isNull(), F.col("n")).otherwise(shared)
    return described.filter("n > 0").join(counts, "batch", "left").filter(alone < _prefix(F.col("n"))).drop("shared")


def parity(tokens: np.ndarray) -> np.ndarray:
    """One bit for each rest of the hashes: whether an odd number of shingles has it."""
    bits = PARITY * 64
    odd = np.bincount((tokens % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts, rows in wordbytes.portions(batch):
            sets = shingle_sets(texts)
            wanted = rows.column("cls").to_pylist()
            keep = [k for k, s in enumerate(sets) if set_class(s) == wanted[k]]
            columns = [
                pa.array([wanted[k] for k in keep], pa.binary()),
                pa.array([sets[k].view(np.int64) for k in keep], pa.list_(pa.int64())),
                pa.array([parity(sets[k]) for k in keep], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["cls", "tokens", "parity"])


def class_sets(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """``node``, ``cls``, ``n``, ``tokens`` and ``parity`` of each class in ``rows``, stored."""
    chosen = stored(rows.groupBy("cls").agg(F.min("doc_id").alias("_id")), "jaccard-classes")
    few = chosen.count() <= BROADCAST_ROWS
    chosen = F.broadcast(chosen) if few else chosen
    texts = documents.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id"))).select("cls", "text")
    sets = texts.mapInArrow(_checked, "cls binary, tokens array<long>, parity array<long>").dropDuplicates(["cls"])
    numbered = sets.select(F.monotonically_increasing_id().alias("node"), "cls", F.size("tokens").alias("n"), "tokens", "parity")
    return stored(numbered, "jaccard-sets")


def prefixes(sets: DataFrame) -> DataFrame:
    """``node``, ``n`` and the prefixes ``rare``, ``rare_down``, ``hashed`` of the classes that can have a partner."""
    places = sets.select("node", F.explode("tokens").alias("token"))
    counts = places.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    listed = places.join(counts, "token").groupBy("node").agg(F.collect_list(F.struct("df", "token")).alias("held"))
    rest = _prefix(F.col("n")) - (F.col("n") - F.size("held"))

    def cut(by) -> Column:
        ordered = F.array_sort(F.transform("held", by))
        return F.transform(F.slice(ordered, F.lit(1), F.col("rest")), lambda s: s["token"])

    kept = sets.join(listed, "node").withColumn("rest", rest).filter("rest > 0")
    return kept.select(
        "node",
        "n",
        "parity",
        cut(lambda s: F.struct(s["df"], s["token"].alias("by"), s["token"])).alias("rare"),
        cut(lambda s: F.struct(s["df"], (-s["token"]).alias("by"), s["token"])).alias("rare_down"),
        F.slice("tokens", F.lit(1), _prefix(F.col("n"))).alias("hashed"),
    )


def _likely(x: str, y: str) -> Column:
    """Whether sizes and signatures of two sides allow the similarity."""
    a, b = F.col(f"{x}.n"), F.col(f"{y}.n")
    bits = sum(F.bit_count(F.col(f"{x}.p{k}").bitwiseXOR(F.col(f"{y}.p{k}"))) for k in range(PARITY))
    return (OF * F.least(a, b) >= NEED * F.greatest(a, b)) & (bits * (OF + NEED) <= (a + b) * (OF - NEED))


def verified(pairs: DataFrame, heads: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a``, ``b`` that pass the further orders and the count of common shingles."""

    def beside(df: DataFrame, table: DataFrame, side: str, columns: list[str]) -> DataFrame:
        renamed = table.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns))
        return df.join(renamed, side)

    passed = stored(pairs, "jaccard-pairs")
    for side in "ab":
        passed = beside(passed, heads, side, ["rare_down", "hashed"])
    for order in ("rare_down", "hashed"):
        passed = passed.filter(F.arrays_overlap(f"{order}_a", f"{order}_b"))
    passed = passed.select("a", "b")
    for side in "ab":
        passed = beside(passed, sets, side, ["n", "tokens"])
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return passed.filter(OF * common >= NEED * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")


def links(heads: DataFrame, sets: DataFrame) -> DataFrame:
    """``node``, ``root`` of the classes that links join. Both tables are read several times."""
    files = _dense(stored(heads.select("node", F.explode("rare").alias("token")), "jaccard-files"))
    signed = heads.select("node", "n", *(F.get("parity", F.lit(k)).alias(f"p{k}") for k in range(PARITY)))
    signatures = signed.count()

    def sign(df: DataFrame, node: str, side: str) -> DataFrame:
        """Add size and signature of a class as a struct ``side``."""
        rows = signed.select(F.col("node").alias(node), F.struct(*signed.columns).alias(side))
        return join_few(df, rows, node, signatures, BROADCAST_SIGNED, "inner")

    roots = None
    for draw in range(DRAWS + 1):
        mixed = _mixed(files, roots)
        by = F.xxhash64("token", "node", F.lit(draw)) if draw else F.col("node")
        ends = mixed.groupBy("token").agg(F.min(F.struct(by.alias("by"), F.col("node").alias("head"), F.col("root").alias("other"))).alias("_end"))
        met = mixed.join(ends, "token").filter(F.col("root") != F.col("_end.other"))
        met = met.select(F.col("node").alias("a"), F.col("_end.head").alias("b")).distinct()
        likely = sign(sign(met, "a", "x"), "b", "y").filter(_likely("x", "y"))
        one = likely.groupBy("a").agg(F.min_by("b", F.xxhash64("a", "b", F.lit(draw))).alias("b"))
        roots = _joined(roots, stored(verified(one, heads, sets), "jaccard-links"))
    mixed = _mixed(files, roots)
    sizes = mixed.groupBy("token", "root").agg(F.count(F.lit(1)).alias("held"))
    main = sizes.groupBy("token").agg(F.max_by("root", F.struct("held", "root")).alias("main"))
    rest = sign(mixed.join(main, "token"), "node", "s").select("token", "root", "main", "s.*")
    rest = stored(rest, "jaccard-rest")
    once = (F.col("y.root") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))
    last = stored(verified(_met_pairs(rest.filter("root <> main"), rest, once), heads, sets), "jaccard-links")
    return _joined(roots, last)


def _dense(table: DataFrame) -> DataFrame:
    """A stored table, read by no more tasks than its rows fill."""
    return in_tasks(table, max(1, -(-table.count() // ROWS_A_TASK)))


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components of earlier ones, as links of their members to the root, and new links."""
    both = links if roots is None else links.union(roots.select("node", "root"))
    return _dense(stored(graph.components(both, ROWS_A_TASK), "jaccard-roots"))


def _met_pairs(x: DataFrame, y: DataFrame, more: Column) -> DataFrame:
    """Pairs of different components that meet in a file and may be similar."""
    met = x.alias("x").join(
        y.alias("y"),
        (F.col("x.token") == F.col("y.token")) & (F.col("x.root") != F.col("y.root")) & more & _likely("x", "y"),
    )
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _placed(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return rows.withColumn("root", F.col("node"))
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _mixed(files: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The files that still hold several components."""
    placed = _placed(files, roots)
    several = placed.groupBy("token").agg(F.min("root").alias("_l"), F.max("root").alias("_h")).filter("_l <> _h")
    return _dense(stored(placed.join(several.select("token"), "token"), "jaccard-mixed"))


def near_documents(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of each document."""
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = dict(texts.dtypes)["doc_id"]
    columns = f"doc_id {id_type}, n long, cls binary, batch long, place int, local long"
    described = stored(texts.mapInArrow(_described, columns), "jaccard-documents")
    sets = class_sets(texts, possible(texts, described))
    heads = stored(prefixes(sets), "jaccard-prefixes")
    linked = links(heads, sets)
    linked = linked.union(linked.select("root", "root").distinct())
    rooted = stored(linked.join(sets.select("node", "cls"), "node").select("cls", "root"), "jaccard-rooted")
    classes = described.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    named = classes.join(rooted, "cls", "left").filter("copies > 1 OR root IS NOT NULL")
    named = stored(named, "jaccard-named")
    whole = named.filter("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("first"))
    names = named.join(whole, "root", "left").select("cls", F.coalesce("first", "least").alias("component_id"), F.lit(True).alias("_named"))
    names = stored(names, "jaccard-names")
    return join_few(described.select("doc_id", "n", "cls"), names, "cls", names.count(), BROADCAST_ROWS).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("_named"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles,
       least(w.doc_id, coalesce((SELECT min(r.b) FROM r WHERE r.a = w.doc_id), w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id"""
