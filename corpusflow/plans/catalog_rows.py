"""Queries: ordering, preparation, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.functions import state as S, text as X
from corpusflow.operators import ordinal, prepare
from corpusflow.operators.layout import spread
from corpusflow.plans.inputs import DIALOGUES, QUESTIONS, dialogues, questions, sql_normalize, sql_strip
from corpusflow.plans.registry import query
from corpusflow.session import scratch_path
from corpusflow.sources import history, tables
from corpusflow.sources.tables import read_table

# Fixed values in the SQL below: prompt, rejection, summary and marker texts, spelled out.
DATE_ORDER = ["o_orderdate", "o_orderkey"]


# --- row order ---------------------------------------------------------------


@query("""
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS ord FROM orders""")
def global_ordinal(spark, sf):
    orders = read_table(spark, sf, "orders").select(*DATE_ORDER)
    return ordinal.global_ordinal(orders, DATE_ORDER).select("o_orderkey", "ord")


@query("""
SELECT o_orderkey,
       row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS ord
FROM orders""")
def group_ordinal(spark, sf):
    orders = read_table(spark, sf, "orders").select("o_orderpriority", *DATE_ORDER)
    return ordinal.group_ordinal(orders, ["o_orderpriority"], DATE_ORDER).select("o_orderkey", "ord")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 500")
def head(spark, sf):
    rows = ordinal.head(read_table(spark, sf, "orders"), 500, DATE_ORDER)
    return rows.select("o_orderkey", "o_totalprice")


@query("""
SELECT o_orderkey, o_totalprice FROM orders
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500""")
def tail(spark, sf):
    rows = ordinal.tail(read_table(spark, sf, "orders"), 500, DATE_ORDER)
    return rows.select("o_orderkey", "o_totalprice")


@query("""
SELECT o_orderpriority, count(*) AS kept
FROM (SELECT o_orderpriority FROM orders ORDER BY o_orderpriority LIMIT 5000) GROUP BY o_orderpriority""")
def head_large(spark, sf):
    """The first rows by a key that repeats; which rows of the last value is left open."""
    rows = ordinal.head(read_table(spark, sf, "orders"), 5000, ["o_orderpriority"])
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("kept"))


@query("""
SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 3 < 2 THEN repeat('h', 300)
       ELSE repeat('h', 299) || o_orderstatus END, o_orderkey) - 1 AS ord
FROM orders""")
def long_key_ordinal(spark, sf):
    """One long text holds two thirds of the rows."""
    text = F.when(F.col("o_orderkey") % 3 < 2, F.expr("repeat('h', 300)")).otherwise(
        F.concat(F.expr("repeat('h', 299)"), F.col("o_orderstatus"))
    )
    rows = read_table(spark, sf, "orders").select("o_orderkey", text.alias("path"))
    return ordinal.global_ordinal(rows, ["path", "o_orderkey"]).select("o_orderkey", "ord")


@query("""
SELECT o_orderpriority, count(*) AS placed, min(ord) AS first, max(ord) AS last
FROM (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS ord FROM orders)
GROUP BY o_orderpriority""")
def shards_ties(spark, sf):
    """Aligned positions by a key that repeats."""
    placed = ordinal.aligned_ordinal(read_table(spark, sf, "orders"), ["o_orderpriority"], 16)
    return placed.groupBy("o_orderpriority").agg(
        F.count_distinct("ord").alias("placed"), F.min("ord").alias("first"), F.max("ord").alias("last")
    )


@query("""
SELECT shard_id, l_returnflag, l_linestatus, count(*) AS "rows"
FROM (SELECT l_returnflag, l_linestatus, (row_number() OVER (ORDER BY l_returnflag, l_linestatus) - 1) // 10000 AS shard_id
      FROM lineitem)
GROUP BY ALL""")
def shards_equal_rows(spark, sf):
    """Shards of a table in which only a few rows differ: equal rows are cut by number."""
    path = scratch_path(spark, "shards-equal-rows")
    flags = read_table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus")
    tables.write_shards(flags, path, ["l_returnflag", "l_linestatus"])
    back = spark.read.parquet(path).groupBy("shard_id", "l_returnflag", "l_linestatus")
    return back.agg(F.count(F.lit(1)).alias("rows")).withColumn("shard_id", F.col("shard_id").cast("long"))


@query("""
SELECT l.o_orderkey, r.c_custkey, l.ord
FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS ord FROM orders) l
JOIN (SELECT *, row_number() OVER (ORDER BY c_mktsegment, c_custkey) - 1 AS ord FROM customer) r
USING (ord)""")
def zip_columns(spark, sf):
    left = ordinal.global_ordinal(read_table(spark, sf, "orders").select(*DATE_ORDER), DATE_ORDER)
    by = ["c_mktsegment", "c_custkey"]
    right = ordinal.global_ordinal(read_table(spark, sf, "customer").select(*by), by)
    return ordinal.zip_columns(left, right).select("o_orderkey", "c_custkey", "ord")


@query("""
SELECT 'raw/shard_' || lpad(p_partkey::VARCHAR, greatest(3, length(p_partkey::VARCHAR))::INT, '0')
       || '.parquet' AS path,
       row_number() OVER (ORDER BY p_partkey) - 1 AS position
FROM part""")
def sort_files(spark, sf):
    number = F.col("p_partkey").cast("string")
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    names = read_table(spark, sf, "part").select(
        F.concat(F.lit("raw/shard_"), padded, F.lit(".parquet")).alias("path")
    )
    return ordinal.sort_files(names)


@query("""
SELECT p_partkey, array_to_string(list_sort([p_type, p_brand, p_name]), ',') AS packages FROM part""")
def sorted_items(spark, sf):
    items = S.sorted_items(F.array("p_type", "p_brand", "p_name"))
    return read_table(spark, sf, "part").select(
        "p_partkey", F.array_join(items, ",").alias("packages")
    )


# --- filters, prompts, validation ----------------------------------------------


@query("""
SELECT d.doc_id, d.text, l.quality, l.toxic
FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE d.doc_id IS NOT NULL AND d.text IS NOT NULL AND l.quality IS NOT NULL AND l.toxic IS NOT NULL""")
def clean_rows(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return prepare.clean_rows(docs.join(read_table(spark, sf, "labels"), "doc_id", "left"))


@query(f"""
SELECT conv_id, turn, 'translate English to SQL: ' || question || ' </s> Tables: ' ||
       coalesce(context, 'None') AS prompt
FROM {QUESTIONS}""")
def format_prompt(spark, sf):
    return questions(spark, sf).select(
        "conv_id", "turn", X.format_prompt("question", "context").alias("prompt")
    )


@query(f"""
SELECT 'translate English to SQL: ' || question || ' </s> Tables: ' || coalesce(context, 'None')
       AS input_text, answer AS target_text
FROM {DIALOGUES}""")
def to_pairs(spark, sf):
    return prepare.to_pairs(dialogues(spark, sf))


def _requests_to_check(spark, sf):
    return questions(spark, sf).select(
        "conv_id",
        "turn",
        F.when(F.col("turn") == 4, F.lit("  \n")).otherwise(F.col("question")).alias("question"),
        "context",
    )


@query(f"""
SELECT conv_id, turn,
       CASE WHEN turn = 4 THEN 400 WHEN context IS NULL THEN 400 END AS code,
       CASE WHEN turn = 4 THEN 'question cannot be empty'
            WHEN context IS NULL THEN 'context (CREATE TABLE) cannot be empty' END AS detail
FROM {QUESTIONS}""")
def validate_requests(spark, sf):
    checked = prepare.checked_requests(_requests_to_check(spark, sf))
    return checked.select("conv_id", "turn", "code", "detail")


@query("""
SELECT doc_id, encoded_length, encoded_length <= 4000 AS accepted
FROM (SELECT doc_id, CAST(ceil(octet_length(encode(text)) / 3.0) * 4 AS BIGINT) AS encoded_length
      FROM documents)""")
def payload_guard(spark, sf):
    sized = prepare.sized_payloads(spread(read_table(spark, sf, "documents")), "text", 4000)
    return sized.select("doc_id", "encoded_length", "accepted")


@query("""
SELECT doc_id, text, CAST(NULL AS INTEGER) AS quality, CAST(NULL AS BIGINT) AS item_id FROM documents
UNION ALL SELECT doc_id, NULL, quality, NULL FROM labels
UNION ALL SELECT NULL, text, NULL, item_id FROM benchmark""")
def concat_tables(spark, sf):
    return prepare.concat_tables(
        [
            read_table(spark, sf, "documents").select("doc_id", "text"),
            read_table(spark, sf, "labels").select("quality", "doc_id"),
            read_table(spark, sf, "benchmark").select("item_id", "text"),
        ]
    )


@query(f"""
WITH seen AS (SELECT DISTINCT {sql_normalize('text')} AS t FROM documents),
     numbered AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n, count(*) OVER () AS total
                  FROM orders),
     tail AS (SELECT * FROM numbered WHERE n > total - ceil(total / 10.0))
SELECT 'benchmark' AS held_out, count(*) AS held, count(t) AS leaked, avg(CAST(t IS NOT NULL AS INT)) AS share
FROM benchmark LEFT JOIN seen ON t = {sql_normalize('text')}
UNION ALL
SELECT 'tail_rows', count(*), count(*) FILTER (n % 5 > 0), avg(CAST(n % 5 > 0 AS INT)) FROM tail""")
def leak_audit(spark, sf):
    """Benchmark texts among the documents, and the last rows of a table that was split by number."""
    texts = prepare.leak_audit(
        read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"), {"text": X.normalize_text("text")}
    )
    orders = read_table(spark, sf, "orders").select("o_orderkey")
    numbered = ordinal.global_ordinal(orders, ["o_orderkey"], "n")
    held = ordinal.tail_where(orders, F.ceil(F.col("total") / 10), ["o_orderkey"])
    rows = prepare.leak_audit(numbered.where((F.col("n") + 1) % 5 > 0), held, ["o_orderkey"])
    return prepare.concat_tables(
        [a.select(F.lit(n).alias("held_out"), "*") for n, a in (("benchmark", texts), ("tail_rows", rows))]
    )


# --- text functions -------------------------------------------------------------


@query(f"SELECT doc_id, {sql_normalize('text')} AS normalized FROM documents")
def normalize_text(spark, sf):
    docs = spread(read_table(spark, sf, "documents"))
    return docs.select("doc_id", X.normalize_text("text").alias("normalized"))


@query(f"""
SELECT doc_id, {sql_strip("chr(160) || text || chr(10) || chr(28)")} AS stripped FROM documents""")
def strip_text(spark, sf):
    padded = F.concat(F.lit(" "), F.col("text"), F.lit("\n\x1c"))
    docs = spread(read_table(spark, sf, "documents"))
    return docs.select("doc_id", X.strip_text(padded).alias("stripped"))


@query(f"""
SELECT doc_id, {sql_normalize('text')} = {sql_normalize("replace(text, ' ', chr(160) || ' ')")}
       AND lang <> 'de' AS matched
FROM documents""")
def exact_match(spark, sf):
    wide = F.replace(F.col("text"), F.lit(" "), F.lit("  "))
    other = F.when(F.col("lang") == "de", F.concat(F.col("text"), F.lit("!"))).otherwise(wide)
    docs = spread(read_table(spark, sf, "documents"))
    return docs.select("doc_id", X.exact_match(other, "text").alias("matched"))


@query("""
SELECT p_partkey, len(pieces)::INT AS statements, array_to_string(pieces, '|') AS ddl
FROM (SELECT p_partkey,
        list_filter(list_transform(string_split(
          ' create table t' || p_size || ' (a text default ''' || p_name || ';' || p_type || ''');' ||
          'DROP TABLE x; Create View v AS SELECT ''' || p_brand || ''';', ';'), lambda x: trim(x)),
          lambda x: upper(x) LIKE 'CREATE%') AS pieces
      FROM part)""")
def ddl_statements(spark, sf):
    context = F.format_string(
        " create table t%d (a text default '%s;%s');DROP TABLE x; Create View v AS SELECT '%s';",
        "p_size", "p_name", "p_type", "p_brand",
    )
    pieces = X.ddl_statements(context)
    return read_table(spark, sf, "part").select(
        "p_partkey", F.size(pieces).alias("statements"), F.array_join(pieces, "|").alias("ddl")
    )


@query(r"""
SELECT page_id, list_last(string_split(regexp_replace(url || CASE WHEN page_id % 2 = 0 THEN '//' ELSE '' END,
       '/+$', ''), '/')) AS last_part
FROM pages""")
def last_segment(spark, sf):
    url = F.concat(F.col("url"), F.when(F.col("page_id") % 2 == 0, "//").otherwise(""))
    return read_table(spark, sf, "pages").select("page_id", X.last_segment(url).alias("last_part"))


@query("SELECT doc_id, CASE WHEN lang <> 'de' THEN text END AS payload FROM documents")
def marked_payload(spark, sf):
    plain = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\s", "")
    end = F.when(F.col("lang") == "de", "__RESULT_STOP__").otherwise("__RESULT_END__")
    log = F.concat(F.lit("started\n__RESULT_START__\n"), plain, F.lit("\n"), end, F.lit("\ndone"))
    docs = spread(read_table(spark, sf, "documents"))
    return docs.select("doc_id", F.decode(X.marked_payload(log), "UTF-8").alias("payload"))


# --- splits, encoding, batches ----------------------------------------------------

_SPLIT = """(
  SELECT o_orderkey, o_orderdate, CASE
           WHEN r <= n - held THEN 'train'
           WHEN r <= n - ceil(held * 0.5::DOUBLE) THEN 'val' ELSE 'test' END AS split,
         row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS from_end,
         ceil(held * 0.5::DOUBLE) AS tested
  FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) AS r,
               count(*) OVER () AS n, ceil(count(*) OVER () * 0.2::DOUBLE) AS held
        FROM orders))"""


@query(f"SELECT o_orderkey, split FROM {_SPLIT}")
def split_rows(spark, sf):
    return prepare.split_rows(read_table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query(f'SELECT split, count(*) AS "rows" FROM {_SPLIT} GROUP BY split')
def split_counts(spark, sf):
    return prepare.split_counts(split_rows(spark, sf))


@query(f"SELECT o_orderkey FROM {_SPLIT} WHERE split = 'test'")
def raw_holdout(spark, sf):
    return prepare.raw_holdout(read_table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query(f"SELECT o_orderkey FROM {_SPLIT} WHERE from_end <= tested")
def raw_holdout_tail(spark, sf):
    orders = read_table(spark, sf, "orders").select(*DATE_ORDER)
    return prepare.raw_holdout(orders, "o_orderkey", DATE_ORDER, "tail").select("o_orderkey")


@query("""
SELECT doc_id, array_to_string(list_resize(ids, 512, 0), ' ') AS input_ids,
       array_to_string(list_resize(list_transform(ids, lambda x: 1), 512, 0), ' ') AS attention_mask,
       array_to_string(list_resize(labels, 128, 0), ' ') AS labels
FROM (SELECT doc_id, list_transform(string_split(text, ''), lambda c: unicode(c)) AS ids,
             list_transform(string_split(source || ' ' || lang, ''), lambda c: unicode(c)) AS labels
      FROM documents)""")
def encode_text(spark, sf):
    docs = read_table(spark, sf, "documents").select(
        "doc_id",
        F.col("text").alias("input_text"),
        F.concat_ws(" ", "source", "lang").alias("target_text"),
    )
    encoded = prepare.encode_text(docs, lambda: prepare.code_points)
    return encoded.select(
        "doc_id", *[F.array_join(c, " ").alias(c) for c in ("input_ids", "attention_mask", "labels")]
    )


def _word_lengths(spark, sf):
    words = F.transform(F.split("text", " "), F.length)
    return spread(read_table(spark, sf, "documents")).select("doc_id", words.alias("lengths"))


_WORD_LENGTHS = """(
  SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w)) AS lengths
  FROM documents)"""


@query(f"""
SELECT doc_id, array_to_string(list_resize(lengths, 256, 0), ' ') AS padded,
       list_sum(list_resize(list_transform(lengths, lambda x: 1), 256, 0))::INT AS kept
FROM {_WORD_LENGTHS}""")
def pad_truncate(spark, sf):
    mask = prepare.attention_mask("lengths", 256)
    return _word_lengths(spark, sf).select(
        "doc_id",
        F.array_join(prepare.pad_truncate("lengths", 256), " ").alias("padded"),
        F.aggregate(mask, F.lit(0), lambda a, b: a + b).alias("kept"),
    )


@query(f"""
SELECT batch, doc_id, width, md5(array_to_string(list_resize(lengths, width, -100), ' ')) AS padded
FROM (SELECT *, max(len(lengths)) OVER (PARTITION BY batch) AS width
      FROM (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch FROM {_WORD_LENGTHS}))""")
def collate_batches(spark, sf):
    batches = prepare.collate_batches(_word_lengths(spark, sf), ["doc_id"], {"lengths": -100})
    return batches.select(
        "batch",
        "doc_id",
        F.size("lengths").cast("long").alias("width"),
        F.md5(F.array_join("lengths", " ")).alias("padded"),
    )


# --- sources and sinks --------------------------------------------------------------


@query("""
SELECT o_orderkey, o_totalprice, ord, ord // 10000 AS shard_id
FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS ord FROM orders)""")
def shards(spark, sf):
    """Write shards, read them back; the order of rows survives."""
    path = scratch_path(spark, "shards")
    orders = read_table(spark, sf, "orders")
    tables.write_shards(orders, path, DATE_ORDER)
    back = tables.read_shards(spark, path)
    shard = F.floor(F.col("ord") / tables.SHARD_ROWS).cast("long")
    return back.select("o_orderkey", "o_totalprice", "ord", shard.alias("shard_id"))


@query("""
SELECT 'shard_id=' || (ord // 1000) AS folder, count(*) AS "rows", 1 AS files
FROM (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS ord FROM orders)
GROUP BY ord // 1000""")
def list_files(spark, sf):
    """Files per shard folder beside the rows stored in it."""
    path = scratch_path(spark, "listing")
    tables.write_shards(read_table(spark, sf, "orders").select(*DATE_ORDER), path, DATE_ORDER, 1000)
    files = tables.list_files(spark, path, "*.parquet").select(
        F.substring_index(F.substring_index("path", "/", -2), "/", 1).alias("folder")
    )
    stored = spark.read.parquet(path).groupBy("shard_id").agg(F.count("*").alias("rows"))
    named = stored.select(F.concat(F.lit("shard_id="), F.col("shard_id")).alias("folder"), "rows")
    counts = files.groupBy("folder").agg(F.count("*").cast("int").alias("files"))
    return named.join(counts, "folder")


@query(f"SELECT o_orderkey FROM {_SPLIT} WHERE split = 'val'")
def splits(spark, sf):
    """Write one folder per split, read one of them."""
    path = scratch_path(spark, "splits")
    tables.write_splits(split_rows(spark, sf), path)
    return tables.read_split(spark, path, "val")


@query(f"SELECT question, context, answer FROM {DIALOGUES}")
def read_examples(spark, sf):
    """Store examples as a table, read them against the declared schema."""
    path = scratch_path(spark, "examples")
    tables.write_table(dialogues(spark, sf).select("question", "context", "answer"), path)
    return tables.read_examples(spark, path)


@query("""
SELECT 'run-' || user_id AS run_id, 'metric' AS kind, unnest(['eval_loss', 'event']) AS key,
       unnest([CAST(arg_max(value, (ts, event_id)) AS VARCHAR),
               CAST(arg_max(event_id, (ts, event_id)) AS VARCHAR)]) AS value
FROM events GROUP BY user_id
UNION ALL
SELECT 'run-' || user_id, 'tag', 'last_type', arg_max(event_type, (ts, event_id))
FROM events GROUP BY user_id""")
def append_metrics(spark, sf):
    """Append two kinds of entries to one history; keep the last value of each key."""
    path = scratch_path(spark, "history")
    events = read_table(spark, sf, "events").withColumn(
        "run", F.concat(F.lit("run-"), F.col("user_id"))
    )
    values = {"eval_loss": "value", "event": "event_id"}
    history.append_metrics(history.metric_rows(events, "run", values, at="ts"), path)
    tags = history.metric_rows(events, "run", {"last_type": "event_type"}, "tag", at="ts")
    history.append_metrics(tags, path)
    return history.latest_metrics(history.read_metrics(spark, path))


@query("SELECT p_brand, count(*) AS parts FROM part GROUP BY p_brand")
def materialize(spark, sf):
    """Build a step once; a second call with the same version and inputs reads it."""
    root = scratch_path(spark, "steps")
    built = []

    def build():
        built.append(1)
        return read_table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("parts"))

    for _ in range(2):
        out = history.materialize(spark, "parts_per_brand", "1.0", {"part": sf}, build, root)
    assert len(built) == 1
    return out
