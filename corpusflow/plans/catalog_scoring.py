"""Queries: inference, matching, metrics, runs and versions, user functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from corpusflow.functions import state as S, text as X
from corpusflow.operators import mapping, prepare, runs, scoring
from corpusflow.operators.layout import spread
from corpusflow.operators.ordinal import global_ordinal
from corpusflow.plans.inputs import (
    CHECKPOINTS,
    DIALOGUES,
    QUESTIONS,
    PREDICTIONS,
    checkpoints,
    dialogues,
    questions,
    predictions,
    sql_strip,
)
from corpusflow.plans.registry import query
from corpusflow.session import scratch_path
from corpusflow.sources.tables import read_table

# Fixed values in the SQL below: prompt, rejection, summary and marker texts, spelled out.


def echo_question():
    """Stand-in model: answers with the question of the prompt between blanks."""

    def predict(prompts):
        head, tail = len(X.PROMPT_HEAD), X.PROMPT_TABLES
        return [f"  {p[head:].split(tail)[0]}\n" for p in prompts]

    return predict


@query(f"""
SELECT conv_id, turn, {sql_strip("string_split(question, ' </s> Tables: ')[1]")} AS predicted
FROM {QUESTIONS}""")
def predict_batch(spark, sf):
    prompts = questions(spark, sf).select(
        "conv_id", "turn", X.format_prompt("question", "context").alias("prompt")
    )
    return scoring.predict_batch(prompts, echo_question).select("conv_id", "turn", "predicted")


@query(f"""
SELECT conv_id, turn, {sql_strip('question')} AS sql,
       'translate English to SQL: ' || question || ' </s> Tables: ' || context AS prompt
FROM {QUESTIONS} WHERE context IS NOT NULL""")
def score_requests(spark, sf):
    answered = scoring.score_requests(questions(spark, sf), echo_question)
    return answered.select("conv_id", "turn", "sql", "prompt")


def judged(spark, sf):
    """Predictions with both verdicts."""
    rows = predictions(spark, sf).withColumn(
        "exact_match", X.exact_match("predicted", "answer")
    )
    return scoring.execution_match(spread(rows))


@query(f"SELECT p_partkey, exact_match, exec_match FROM {PREDICTIONS}")
def execution_match(spark, sf):
    return judged(spark, sf).select("p_partkey", "exact_match", "exec_match")


@query(f"SELECT avg(CAST(exact_match AS INT)) AS exact_match_accuracy FROM {PREDICTIONS}")
def exact_match_accuracy(spark, sf):
    return scoring.exact_match_accuracy(predictions(spark, sf))


@query(f"SELECT avg(CAST(exec_match AS INT)) AS execution_accuracy FROM {PREDICTIONS}")
def execution_accuracy(spark, sf):
    return scoring.execution_accuracy(judged(spark, sf))


_SUMMARY = f"""(
  SELECT p_brand AS run_id, avg(CAST(exact_match AS INT)) AS exact_match_accuracy,
         avg(CAST(exec_match AS INT)) AS execution_accuracy, count(*) AS num_examples,
         CAST(0 AS BIGINT) AS limited
  FROM {PREDICTIONS} GROUP BY p_brand)"""


@query(f"SELECT * FROM {_SUMMARY}")
def evaluation_summary(spark, sf):
    return scoring.evaluation_summary(judged(spark, sf), run="p_brand").withColumnRenamed(
        "p_brand", "run_id"
    )


@query(f"""
SELECT substr(run_id, 1, 8) || '...' AS run,
       CASE WHEN exact_match_accuracy >= 0.5 THEN 'Good' ELSE 'Warning' END AS exact_status,
       CASE WHEN execution_accuracy >= 0.35 THEN 'Good' ELSE 'Warning' END AS exec_status,
       printf('%.1f%%', exact_match_accuracy * 100) AS exact_percent,
       printf('%.1f%%', execution_accuracy * 100) AS exec_percent,
       'Exact Match: ' || printf('%.4f', exact_match_accuracy) || chr(10) ||
       'Execution Accuracy: ' || printf('%.4f', execution_accuracy) AS summary
FROM {_SUMMARY}""")
def run_report(spark, sf):
    """Status, percentages and the two-line summary per run."""
    table = evaluation_summary(spark, sf)
    raised = F.col("execution_accuracy") + 0.15
    return table.select(
        X.short_id("run_id").alias("run"),
        X.quality_status("exact_match_accuracy").alias("exact_status"),
        X.quality_status(raised).alias("exec_status"),
        X.percent("exact_match_accuracy").alias("exact_percent"),
        X.percent("execution_accuracy").alias("exec_percent"),
        X.summary_text("exact_match_accuracy", "execution_accuracy").alias("summary"),
    )


@query(f"""
SELECT exact_match, exec_match, count(*) AS "rows" FROM {PREDICTIONS}
GROUP BY exact_match, exec_match""")
def agreement_table(spark, sf):
    return scoring.agreement_table(judged(spark, sf))


@query(f"""
SELECT question, predicted, gold, exact_match FROM (
  SELECT q.question, a.text AS predicted, q.answer AS gold, q.conv_id, q.turn, TRUE AS exact_match
  FROM {DIALOGUES} q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1)
ORDER BY conv_id, turn LIMIT 20""")
def example_report(spark, sf):
    rows = dialogues(spark, sf).withColumn("predicted", F.col("answer"))
    return scoring.example_report(rows, ["conv_id", "turn"])


def _result_pairs(spark, sf):
    """Orders in two orders, and with one column changed where a condition holds."""
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    stored = []
    for keys in (["o_orderdate", "o_orderkey"], ["o_orderkey"]):
        path = scratch_path(spark, "results")
        global_ordinal(orders, keys).write.parquet(path)
        stored.append(spark.read.parquet(path))
    return stored


@query("""
WITH d AS (SELECT o_orderkey, o_orderdate, o_custkey,
                  row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS ord FROM orders),
     k AS (SELECT o_orderkey, o_orderdate, o_custkey,
                  row_number() OVER (ORDER BY o_orderkey) AS ord FROM orders)
SELECT 'other_order' AS pair, count(*) = 0 AS same FROM (FROM d EXCEPT ALL FROM k)
UNION ALL
SELECT 'as_bags', count(*) = 0
FROM (SELECT o_orderkey, o_orderdate, o_custkey FROM d EXCEPT ALL
      SELECT o_orderkey, o_orderdate, o_custkey FROM k)
UNION ALL
SELECT 'bag_of_customers', count(*) = 0
FROM (SELECT o_custkey FROM orders EXCEPT ALL SELECT c_custkey FROM customer)
UNION ALL SELECT 'failed_side', FALSE FROM (SELECT count(*) FROM orders)
UNION ALL SELECT 'other_names', TRUE FROM (SELECT count(*) FROM orders)
UNION ALL
SELECT 'swapped_columns', count(*) = 0
FROM (SELECT ord, o_orderkey, o_orderdate, o_custkey FROM d EXCEPT ALL
      SELECT ord, o_custkey, o_orderdate, o_orderkey FROM d)""")
def same_result(spark, sf):
    by_date, by_key = _result_pairs(spark, sf)
    named = by_date.withColumnsRenamed({"o_orderkey": "id", "o_custkey": "who"})
    swapped = by_date.select("o_custkey", "o_orderdate", "o_orderkey", "ord")
    bought = read_table(spark, sf, "orders").select("o_custkey")
    listed = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"))
    answers = {
        "other_order": scoring.same_result(spark, by_date, by_key),
        "as_bags": scoring.same_result(
            spark, by_date.drop("ord"), by_key.drop("ord"), ordinal=None
        ),
        "bag_of_customers": scoring.same_result(spark, bought, listed, ordinal=None),
        "failed_side": scoring.same_result(spark, by_date, None),
        "other_names": scoring.same_result(spark, by_date, named),
        "swapped_columns": scoring.same_result(spark, by_date, swapped),
    }
    return prepare.concat_tables(
        [a.select(F.lit(name).alias("pair"), "same") for name, a in answers.items()]
    )


# --- runs and versions ----------------------------------------------------------


@query(f"""
SELECT run_id, arg_min(name, (eval_loss, event_id)) AS best, min(eval_loss) AS best_loss
FROM {CHECKPOINTS} WHERE is_dir AND name LIKE 'checkpoint-%' AND name <> 'checkpoint-best'
GROUP BY run_id""")
def best_checkpoint(spark, sf):
    numbered, _ = runs.checkpoint_listing(checkpoints(spark, sf))
    return runs.best_checkpoint(numbered)


@query(f"""
SELECT run_id, 'checkpoint-' || max(event_id) AS latest, max(event_id) AS step
FROM {CHECKPOINTS} WHERE is_dir AND name LIKE 'checkpoint-%' AND name <> 'checkpoint-best'
GROUP BY run_id""")
def latest_checkpoint(spark, sf):
    return runs.latest_checkpoint(checkpoints(spark, sf))


@query(f"""
SELECT run_id, name, TRY_CAST(list_last(string_split(name, '-')) AS BIGINT) AS step
FROM {CHECKPOINTS}""")
def checkpoint_step(spark, sf):
    return checkpoints(spark, sf).select("run_id", "name", S.checkpoint_step("name").alias("step"))


@query("""
SELECT name, latest_version, coalesce(latest_version, 0) + 1 AS next_version,
       'models:/' || name || '/' || (coalesce(latest_version, 0) + 1) AS uri
FROM (SELECT DISTINCT lower(p_brand) || '-' || p_type AS name FROM part)
LEFT JOIN (SELECT lower(p_brand) || '-' || p_type AS name, max(p_size) AS latest_version
           FROM part WHERE p_type <> 'SMALL' GROUP BY 1) USING (name)""")
def next_version(spark, sf):
    part = read_table(spark, sf, "part")
    named = part.withColumn("name", F.concat_ws("-", F.lower("p_brand"), "p_type"))
    history = named.where("p_type <> 'SMALL'").withColumn("version", F.col("p_size"))
    return runs.next_version(history, named)


# --- user functions ----------------------------------------------------------------


def inspect_part(p_name, p_size):
    """Prints, and fails for every size that is a multiple of seven."""
    print(p_name)
    if p_size % 7 == 0:
        raise ValueError(f"size {p_size}")
    return len(p_name) * p_size


@query("""
SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN length(p_name) * p_size END AS return_value,
       p_size % 7 <> 0 AS ok, CASE WHEN p_size % 7 = 0 THEN 'size ' || p_size END AS error,
       p_name || chr(10) AS stdout
FROM part""")
def safe_map(spark, sf):
    called = mapping.safe_map(
        spread(read_table(spark, sf, "part")), inspect_part, ["p_name", "p_size"], "long", ["p_partkey"]
    )
    return called.select("p_partkey", "return_value", "ok", "error", "stdout")


def count_words(batch: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"words": batch["text"].str.count(" ") + 1})


@query("SELECT doc_id, len(string_split(text, ' ')) AS words FROM documents")
def map_batches(spark, sf):
    docs = spread(read_table(spark, sf, "documents").select("doc_id", "text"))
    return mapping.map_batches(docs, count_words, "words long", remove_columns=["text"])


def three_lengths(batch: pd.DataFrame) -> pd.DataFrame:
    """Three rows per row."""
    return pd.DataFrame(
        {"id": batch["doc_id"].repeat(3), "part": [0, 1, 2] * len(batch), "chars": batch["text"].str.len().repeat(3)}
    )


@query("SELECT doc_id AS id, part, length(text) AS chars FROM documents, range(3) t(part)")
def map_batches_explode(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return mapping.map_batches(
        docs, three_lengths, "id long, part long, chars long", remove_columns=["doc_id", "text"]
    )


def doubled(number):
    return None if number is None else number * 2


@query("""
SELECT c_custkey + 9007199254740992 AS id, CASE WHEN c_nationkey % 3 > 0 THEN c_nationkey * 2 END AS return_value
FROM customer""")
def safe_map_nullable(spark, sf):
    rows = read_table(spark, sf, "customer").select(
        (F.col("c_custkey") + 9007199254740992).alias("id"),
        F.when(F.col("c_nationkey") % 3 > 0, F.col("c_nationkey")).alias("number"),
    )
    return mapping.safe_map(rows, doubled, ["number"], "int", ["id"]).select("id", "return_value")
