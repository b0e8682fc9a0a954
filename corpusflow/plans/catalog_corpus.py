"""Queries: chunks, sentences, token counts, vocabulary, class metrics, scaling, overlap, neighbours, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.operators import corpus, embedding, html, prepare, vectors
from corpusflow.operators.layout import spread
from corpusflow.plans.registry import query
from corpusflow.sources.tables import read_table

WORDS = r"list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda w: w <> '')"


@query(f"""
SELECT doc_id, chunk::INT AS chunk, array_to_string(w[chunk * 80 + 1:chunk * 80 + 100], ' ') AS chunk_text
FROM (SELECT doc_id, w, unnest(range(0, ceil(greatest(len(w) - 100, 0) / 80.0)::BIGINT + 1)) AS chunk
      FROM (SELECT doc_id, {WORDS} AS w FROM documents) WHERE len(w) > 0)""")
def chunk_text(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return corpus.chunk_text(docs, 100, 20).drop("text")


@query(r"""
SELECT doc_id, (unnest(range(len(s))))::INT AS position, unnest(s) AS sentence
FROM (SELECT doc_id, list_filter(string_split(
        regexp_replace(text, '([.!?]+)[ \t\n\r]+', '\1' || chr(30), 'g'), chr(30)), lambda x: x <> '') AS s
      FROM documents)""")
def split_sentences(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return corpus.split_sentences(docs).drop("text")


@query(f"""
SELECT lang, count(*) AS texts, CAST(sum(n) AS BIGINT) AS tokens, min(n)::INT AS fewest, avg(n) AS mean, max(n)::INT AS most
FROM (SELECT lang, len({WORDS}) AS n FROM documents) GROUP BY lang""")
def token_stats(spark, sf):
    return corpus.token_stats(read_table(spark, sf, "documents"), ["lang"])


@query("""
WITH c AS (SELECT DISTINCT unnest([quality, toxic]) AS label FROM labels),
     s AS (SELECT label, count(*) FILTER (quality = label AND toxic = label) AS hits,
                  count(*) FILTER (toxic = label) AS claimed, count(*) FILTER (quality = label) AS support
           FROM c, labels GROUP BY label)
SELECT label, CASE WHEN claimed > 0 THEN hits / claimed ELSE 0 END AS precision,
       CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall,
       CASE WHEN claimed + support > 0 THEN 2 * hits / (claimed + support) ELSE 0 END AS f1, support
FROM s""")
def classification_metrics(spark, sf):
    return corpus.classification_metrics(read_table(spark, sf, "labels"), "quality", "toxic")


@query("""
SELECT l_orderkey, l_linenumber,
       round((l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()), 4) AS l_quantity,
       round((l_discount - min(l_discount) OVER ()) / (max(l_discount) OVER () - min(l_discount) OVER ()), 4) AS l_discount
FROM lineitem""")
def min_max(spark, sf):
    rows = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    scaled = corpus.min_max(rows, ["l_quantity", "l_discount"])
    return scaled.withColumns({c: F.round(c, 4) for c in ("l_quantity", "l_discount")})


@query("""
SELECT l_orderkey, l_linenumber, round((l_quantity - m) / d, 4) AS l_quantity
FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS d FROM lineitem)""")
def standardize(spark, sf):
    rows = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return corpus.standardize(rows, ["l_quantity"]).withColumn("l_quantity", F.round("l_quantity", 4))


def _rouge_sql(gram: str, fewest: int) -> str:
    return f"""
WITH t AS (SELECT doc_id, list_transform({WORDS}, lambda x: lower(x)) AS w FROM documents),
     g AS (SELECT doc_id, unnest(range(1, len(w) + 2 - {fewest})) AS i, w FROM t WHERE len(w) >= {fewest}),
     c AS (SELECT doc_id, {gram} AS gram, count(*) AS n FROM g GROUP BY ALL),
     b AS (SELECT c.doc_id, CAST(sum(least(c.n, r.n)) AS BIGINT) AS shared FROM c
           JOIN c r ON r.doc_id = c.doc_id - 1 AND r.gram = c.gram GROUP BY c.doc_id),
     s AS (SELECT d.doc_id, coalesce(b.shared, 0) AS shared, greatest(len(d.w) + 1 - {fewest}, 0) AS claimed,
                  coalesce(greatest(len(r.w) + 1 - {fewest}, 0), 0) AS wanted
           FROM t d LEFT JOIN t r ON r.doc_id = d.doc_id - 1 LEFT JOIN b ON b.doc_id = d.doc_id)
SELECT doc_id, CASE WHEN claimed > 0 THEN shared / claimed ELSE 0 END AS precision,
       CASE WHEN wanted > 0 THEN shared / wanted ELSE 0 END AS recall,
       CASE WHEN claimed + wanted > 0 THEN 2 * shared / (claimed + wanted) ELSE 0 END AS f1
FROM s"""


def _shifted(spark, sf):
    """Each document with the one before it as its reference."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    before = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("reference"))
    return docs.join(before, "doc_id", "left")


@query(_rouge_sql("w[i]", 1))
def rouge_1(spark, sf):
    return corpus.rouge(_shifted(spark, sf), "doc_id", "text", "reference", 1)


@query(_rouge_sql("w[i] || ' ' || w[i + 1]", 2))
def rouge_2(spark, sf):
    return corpus.rouge(_shifted(spark, sf), "doc_id", "text", "reference", 2)


_TURN = WORDS.replace("text", "coalesce(text, '')")


@query(f"""
WITH RECURSIVE t AS (SELECT conv_id, turn, list_transform({_TURN}, lambda x: lower(x)) AS w FROM conversations),
     p AS (SELECT t.conv_id, t.turn, t.w AS c, coalesce(b.w, []) AS r FROM t
           LEFT JOIN t b ON b.conv_id = t.conv_id AND b.turn = t.turn - 1),
     l AS (SELECT conv_id, turn, 0 AS i, c, r, list_transform(range(len(r) + 1), lambda x: 0) AS l FROM p
           UNION ALL
           SELECT conv_id, turn, i + 1, c, r, list_prepend(0, list_transform(range(1, len(r) + 1), lambda j: list_max(m[1:j])))
           FROM (SELECT *, list_transform(range(1, len(r) + 1), lambda j: CASE WHEN r[j] = c[i + 1] THEN l[j] + 1 ELSE l[j + 1] END) AS m
                 FROM l WHERE i < len(c)))
SELECT conv_id * 1000 + turn AS row_id, CASE WHEN len(c) > 0 THEN l[-1] / len(c) ELSE 0 END AS precision,
       CASE WHEN len(r) > 0 THEN l[-1] / len(r) ELSE 0 END AS recall,
       CASE WHEN len(c) + len(r) > 0 THEN 2 * l[-1] / (len(c) + len(r)) ELSE 0 END AS f1
FROM l WHERE i = len(c)""")
def rouge_l(spark, sf):
    """Each turn with the one before it as its reference."""
    turns = read_table(spark, sf, "conversations").select("conv_id", "turn", "text")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    row = (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id")
    pairs = turns.join(before, ["conv_id", "turn"], "left").select(row, "text", "reference")
    return corpus.rouge_l(pairs, "row_id", "text", "reference")


_VOCAB = f"""(SELECT word, (row_number() OVER (ORDER BY n DESC, word) + 1)::INT AS id, n
  FROM (SELECT word, count(*) AS n FROM (SELECT unnest({WORDS}) AS word FROM documents) GROUP BY word
        ORDER BY n DESC, word LIMIT 2000))"""


@query(f"SELECT * FROM {_VOCAB}")
def build_vocab(spark, sf):
    return corpus.build_vocab(read_table(spark, sf, "documents"), 2000)


@query(f"""
WITH v AS {_VOCAB},
     w AS (SELECT doc_id, unnest({WORDS}) AS word, unnest(range(1, len({WORDS}) + 1)) AS i FROM documents),
     e AS (SELECT doc_id, list(coalesce(id, 1) ORDER BY i) AS ids FROM w LEFT JOIN v USING (word) WHERE i <= 512 GROUP BY doc_id)
SELECT doc_id, array_to_string(list_resize(coalesce(ids, []), 512, 0), ' ') AS input_ids
FROM documents LEFT JOIN e USING (doc_id)""")
def encode_vocab(spark, sf):
    """Word ids of a vocabulary that is built from the same texts."""
    docs = read_table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("input_text"), F.lit("").alias("target_text"))
    load = corpus.vocab_encoder(corpus.build_vocab(docs, 2000, "input_text"))
    encoded = prepare.encode_text(docs, load)
    return encoded.select("doc_id", F.array_join("input_ids", " ").alias("input_ids"))


@query("""
SELECT query, rank::INT AS rank, vec_id, round(distance, 6) AS distance FROM (
  SELECT q.vec_id AS query, v.vec_id, list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS distance,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), v.vec_id) AS rank
  FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)
WHERE rank <= 10""")
def knn(spark, sf):
    """The stated queries, every row whose id is divisible by 20, against all rows."""
    rows = read_table(spark, sf, "embeddings")
    asked = rows.where("vec_id % 20 = 0")
    found = vectors.knn(asked, rows, 10, "vec_id", "vec_id", "embedding")
    return found.select("query", "rank", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


_APPROX = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
     p AS (SELECT t, b, list(CASE WHEN md5(t || ':' || b || ':' || d)[1] < '8' THEN 1.0::DOUBLE ELSE -1.0 END ORDER BY d) AS normal
           FROM range(6) x(t), range(5) y(b), range(64) z(d) GROUP BY t, b),
     s AS (SELECT vec_id, t, b, list_inner_product(v, normal) - avg(list_inner_product(v, normal)) OVER (PARTITION BY t, b) AS side
           FROM e, p),
     r AS (SELECT *, row_number() OVER (PARTITION BY vec_id, t ORDER BY abs(side), b) AS sure FROM s),
     c AS (SELECT vec_id, t, CAST(sum(CASE WHEN side > 0 THEN 1 << b ELSE 0 END) AS BIGINT) AS code,
                  CAST(sum(CASE WHEN sure > 3 THEN 1 << b ELSE 0 END) AS BIGINT) AS mask FROM r GROUP BY vec_id, t),
     m AS (SELECT DISTINCT q.vec_id AS query, x.vec_id FROM c q JOIN c x ON x.t = q.t AND (q.code & q.mask) = (x.code & q.mask)
           WHERE q.vec_id % 20 = 0),
     n AS (SELECT query, m.vec_id, list_distance(a.v, b.v) AS distance FROM m JOIN e a ON a.vec_id = query JOIN e b ON b.vec_id = m.vec_id),
     k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS rank FROM n)"""


@query(f"""{_APPROX}
SELECT query, rank::INT AS rank, vec_id, round(distance, 6) AS distance FROM k WHERE rank <= 10""")
def knn_approx(spark, sf):
    """The stated queries, every row whose id is divisible by 20, against all rows."""
    rows = read_table(spark, sf, "embeddings")
    found = vectors.knn_approx(rows.where("vec_id % 20 = 0"), rows, 10, "vec_id", "vec_id", "embedding")
    return found.select("query", "rank", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


@query(f"""{_APPROX},
     x AS (SELECT a.vec_id AS query, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rank
           FROM e a, e b WHERE a.vec_id % 20 = 0)
SELECT count(*) AS wanted, count(k.vec_id) AS hits, count(k.vec_id) / count(*) AS recall
FROM x LEFT JOIN k ON k.query = x.query AND k.vec_id = x.vec_id AND k.rank <= 10 WHERE x.rank <= 10""")
def knn_recall(spark, sf):
    """The share of the exact neighbours that the approximate search finds, over the same queries."""
    rows = read_table(spark, sf, "embeddings")
    asked, names = rows.where("vec_id % 20 = 0"), ("vec_id", "vec_id", "embedding")
    per_query = vectors.recall(vectors.knn_approx(asked, rows, 10, *names), vectors.knn(asked, rows, 10, *names))
    return per_query.agg(F.sum("wanted").alias("wanted"), F.sum("hits").alias("hits")).withColumn("recall", F.expr("hits / wanted"))


def _decoded_sql(text: str) -> str:
    return f"""array_to_string(list_transform(
      regexp_extract_all({text}, '(?is)&(?:#[0-9]{{1,7}}|#x[0-9a-f]{{1,6}}|[a-z]+);|[^&]+|&'),
      lambda y: CASE y WHEN '&amp;' THEN '&' WHEN '&lt;' THEN '<' WHEN '&gt;' THEN '>' WHEN '&quot;' THEN '"'
        WHEN '&apos;' THEN chr(39) WHEN '&nbsp;' THEN chr(160)
        ELSE CASE WHEN regexp_matches(y, '^&#[0-9]+;$') THEN chr(CAST(y[3:-2] AS INT)) ELSE y END END), '')"""


def _folded_sql(text: str) -> str:
    return rf"trim(regexp_replace({text}, '[ \t\n\r\f]+', ' ', 'g'), ' ')"


def _held_sql(name: str, token: str) -> str:
    return rf"regexp_extract({token}, '(?is)^<[^>]*>(.*?)(?:</{name}[ \t\n\r\f]*>|\z)', 1)"


_ATTRIBUTE = html.ATTRIBUTE.replace("'", "''")
_PARTS = """list_transform(tokens, lambda x: CASE
    WHEN x[1] <> '<' OR x = '<' THEN x
    WHEN regexp_matches(x, '(?i)^<textarea[ \\t\\n\\r\\f/>]') THEN ' ' || {area} || ' '
    WHEN regexp_matches(x, '(?i)^</?({inline})[ \\t\\n\\r\\f/>]') THEN '' ELSE ' ' END)"""


@query(rf"""
WITH t AS (SELECT page_id, html, regexp_extract_all(coalesce(html, ''), '{html.TOKEN.replace("'", "''")}') AS tokens FROM pages),
     s AS (SELECT page_id, html, list_filter(tokens, lambda x: regexp_matches(x, '(?i)^<title[ \t\n\r\f/>]'))[1] AS title,
                  {_PARTS.format(area=_held_sql("textarea", "x"), inline="|".join(html.INLINE))} AS shown,
                  list_filter(list_transform(list_filter(tokens, lambda x: regexp_matches(x, '(?i)^<a[ \t\n\r\f/]')),
                    lambda x: regexp_extract_all(x, '{_ATTRIBUTE}', 2)[list_position(
                      list_transform(regexp_extract_all(x, '{_ATTRIBUTE}', 1), lambda z: lower(z)), 'href')]),
                    lambda x: x IS NOT NULL) AS links FROM t)
SELECT page_id, {_folded_sql(_decoded_sql(_held_sql("title", "title")))} AS title,
       CASE WHEN html IS NOT NULL THEN {_folded_sql(_decoded_sql("array_to_string(shown, '')"))} END AS text,
       len(links)::INT AS n_links,
       array_to_string(list_transform(links, lambda x: {_decoded_sql("trim(x, '''" + '"' + "')")}), chr(10)) AS links
FROM s""")
def parse_html(spark, sf):
    pages = html.parse_html(read_table(spark, sf, "pages").select("page_id", "html"))
    return pages.select("page_id", "title", "text", F.size("links").alias("n_links"), F.array_join("links", "\n").alias("links"))


@query(f"""
WITH w AS (SELECT doc_id, list_transform({_TURN}, lambda x: lower(x)) AS w FROM documents),
     g AS (SELECT doc_id, unnest(w) AS gram FROM w
           UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w)),
     h AS (SELECT doc_id, CAST('0x' || md5(gram)[1:8] AS BIGINT) % 512 AS bucket,
                  sum(CASE WHEN md5(gram)[9] < '8' THEN 1 ELSE -1 END) AS n FROM g GROUP BY ALL),
     p AS (SELECT bucket, dim, CASE WHEN md5('0:' || bucket || ':' || dim)[1] < '8' THEN 1 ELSE -1 END AS side
           FROM range(512) x(bucket), range(16) y(dim)),
     s AS (SELECT doc_id, dim, sum(n * side)::DOUBLE AS value FROM h JOIN p USING (bucket) GROUP BY ALL),
     l AS (SELECT doc_id, sqrt(sum(value * value)) AS size FROM s GROUP BY doc_id)
SELECT doc_id, y.dim::INT AS dim, round(CASE WHEN size > 0 THEN value / size ELSE 0 END, 6) AS value
FROM documents CROSS JOIN range(16) y(dim) LEFT JOIN s USING (doc_id, dim) LEFT JOIN l USING (doc_id)""")
def embed_text(spark, sf):
    docs = embedding.embed_text(spread(read_table(spark, sf, "documents").select("doc_id", "text")), "doc_id", width=16, buckets=512)
    return docs.select("doc_id", F.posexplode("vector").alias("dim", "value")).withColumn("value", F.round("value", 6))
