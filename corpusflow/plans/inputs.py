"""Operator inputs derived from the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusflow.functions.state import config_fingerprint
from corpusflow.sources.tables import read_table

# Values of the priority and status columns of orders.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
STATUSES = ("F", "O", "P")

# White space as the text functions see it, spelled out for the other engine.
WS = (
    r"[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)


def sql_normalize(text: str) -> str:
    return f"trim(lower(regexp_replace({text}, '{WS}', ' ', 'g')))"


def sql_strip(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^{WS}', ''), '{WS}$', '')"


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """User turns with the conversation's system text and the answer that follows, if any."""
    turns = read_table(spark, sf, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    answered = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    system = turns.where("role = 'system'").select("conv_id", F.col("text").alias("context"))
    return asked.join(answered, ["conv_id", "turn"], "left").join(system, "conv_id", "left")


def dialogues(spark: SparkSession, sf: str) -> DataFrame:
    """The questions that were answered."""
    return questions(spark, sf).where(F.col("answer").isNotNull())


QUESTIONS = """(
  SELECT q.conv_id, q.turn, q.text AS question, s.text AS context, a.text AS answer
  FROM conversations q
  LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
  LEFT JOIN conversations s ON s.conv_id = q.conv_id AND s.role = 'system'
  WHERE q.role = 'user')"""
DIALOGUES = f"(SELECT * FROM {QUESTIONS} WHERE answer IS NOT NULL)"


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """One SQL question per part, with a prediction of one of eight kinds."""
    part = read_table(spark, sf, "part")
    table = F.concat(F.lit("part_"), F.col("p_size"))
    gold = F.concat(
        F.lit("SELECT name FROM "), table, F.lit(" WHERE brand = '"), F.col("p_brand"), F.lit("'")
    )
    kinds = {
        0: F.concat(F.lit("\n  "), F.lower(F.replace(gold, F.lit(" "), F.lit("  ")))),
        1: F.concat(F.lit("SELECT count(*) FROM "), table),
        2: F.concat(F.lit("SELECT missing FROM "), table),
        3: F.concat(F.lit('SELECT "missing" FROM '), table),
        4: F.concat(gold, F.lit("; "), gold),
        5: F.concat(F.lit("SELEC name FROM "), table),
        6: F.lit("INSERT INTO spare VALUES (1)"),
    }
    predicted = F.lit(None).cast("string")
    for kind, text in kinds.items():
        predicted = F.when(F.col("p_partkey") % 8 == kind, text).otherwise(predicted)
    return part.select(
        "p_partkey",
        "p_brand",
        F.concat(F.lit("which "), F.col("p_name")).alias("question"),
        F.concat(
            F.lit("CREATE TABLE "),
            table,
            F.lit(" (name TEXT, brand TEXT, size INT); create table spare (a INT)"),
        ).alias("context"),
        gold.alias("answer"),
        predicted.alias("predicted"),
    )


PREDICTIONS = """(
  SELECT p_partkey, p_brand, 'which ' || p_name AS question,
         'SELECT name FROM part_' || p_size || ' WHERE brand = ''' || p_brand || '''' AS answer,
         p_partkey % 8 = 0 AS exact_match,
         p_partkey % 8 IN (0, 3, 6) AS exec_match
  FROM part)"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Activity samples: clicks and purchases are activity."""
    return read_table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("entity"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("event_type").isin("click", "purchase").alias("active"),
    )


SAMPLES = """(
  SELECT CAST(user_id AS VARCHAR) AS entity, ts, event_id AS seq,
         event_type IN ('click', 'purchase') AS active
  FROM events)"""


def pool_log(spark: SparkSession, sf: str) -> DataFrame:
    """Transitions of one resource per user; views are no transition."""
    event = (
        F.when(F.col("event_type") == "signup", "created")
        .when(F.col("event_type") == "click", "assigned")
        .when(F.col("event_type") == "purchase", "succeeded")
        .when(F.col("event_type") == "error", "failed")
        .otherwise("seen")
    )
    return read_table(spark, sf, "events").select(
        F.concat(F.lit("pod-"), F.col("user_id")).alias("pod_name"),
        event.alias("event"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
    )


POOL_LOG = """(
  SELECT 'pod-' || user_id AS pod_name, ts, event_id AS seq,
         CASE event_type WHEN 'signup' THEN 'created' WHEN 'click' THEN 'assigned'
                         WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END AS event
  FROM events WHERE event_type <> 'view')"""

LATEST_STATE = f"""(
  SELECT pod_name,
         CASE WHEN arg_max(event, (ts, seq)) IN ('created', 'assigned')
              THEN 'busy' ELSE 'idle' END AS status,
         max(ts) FILTER (WHERE event <> 'failed') AS last_used,
         max(ts) FILTER (WHERE event = 'created') AS created
  FROM {POOL_LOG} GROUP BY pod_name)"""


def pool(spark: SparkSession, sf: str) -> DataFrame:
    """Resources with status, config hash and insertion order, from customers."""
    priorities = F.array(*[F.lit(p) for p in PRIORITIES])
    statuses = F.array(*[F.lit(s) for s in STATUSES])
    return read_table(spark, sf, "customer").select(
        F.concat(F.lit("pod-"), F.col("c_custkey")).alias("pod_name"),
        F.col("c_custkey").alias("inserted"),
        F.when(F.col("c_mktsegment") == "BUILDING", "busy").otherwise("idle").alias("status"),
        config_fingerprint(
            F.get(priorities, (F.col("c_custkey") % 5).cast("int")),
            F.col("c_custkey") % 3,
            F.get(statuses, F.col("c_nationkey") % 3),
            F.array(F.lit("pandas"), F.lit("numpy")),
        ).alias("config_hash"),
        F.lit("10.0.0.1").alias("pod_ip"),
    )


POOL = f"""(
  SELECT 'pod-' || c_custkey AS pod_name, c_custkey AS inserted,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'busy' ELSE 'idle' END AS status,
         substr(sha256({list(PRIORITIES)}[c_custkey % 5 + 1] || ':' || (c_custkey % 3) || ':' ||
                {list(STATUSES)}[c_nationkey % 3 + 1] || ':numpy,pandas'), 1, 16) AS config_hash
  FROM customer)"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """One pooled request per order, in order of date."""
    return read_table(spark, sf, "orders").select(
        "o_orderkey",
        "o_orderdate",
        config_fingerprint(
            F.col("o_orderpriority"),
            F.col("o_custkey") % 3,
            F.col("o_orderstatus"),
            F.array(F.lit("numpy"), F.lit("pandas")),
        ).alias("config_hash"),
        F.when(F.col("o_custkey") % 3 == 0, 0)
        .when(F.col("o_custkey") % 3 == 1, 600)
        .alias("ttl"),
    )


REQUESTS = """(
  SELECT o_orderkey, o_orderdate,
         substr(sha256(o_orderpriority || ':' || (o_custkey % 3) || ':' || o_orderstatus ||
                ':numpy,pandas'), 1, 16) AS config_hash,
         CASE o_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 600 END AS ttl
  FROM orders)"""


def observed(spark: SparkSession, sf: str) -> DataFrame:
    """What the cluster reports, one resource per part."""
    return read_table(spark, sf, "part").select(
        F.concat(F.lit("pod-"), F.col("p_partkey") * 2).alias("pod_name"),
        F.when(F.col("p_size") % 4 == 0, "Pending").otherwise("Running").alias("phase"),
        F.when(F.col("p_size") % 5 == 1, "")
        .when(F.col("p_size") % 5 != 2, F.concat(F.lit("10.1.0."), F.col("p_size")))
        .alias("ip"),
        F.when(F.col("p_type") != "SMALL", F.col("p_brand")).alias("config_hash"),
        F.when(F.col("p_size") % 3 != 0, F.lit("2024-01-01 00:00:00").cast("timestamp")).alias(
            "created"
        ),
    )


OBSERVED = """(
  SELECT 'pod-' || (p_partkey * 2) AS pod_name,
         CASE WHEN p_size % 4 = 0 THEN 'Pending' ELSE 'Running' END AS phase,
         CASE WHEN p_size % 5 = 1 THEN '' WHEN p_size % 5 <> 2 THEN '10.1.0.' || p_size END AS ip,
         CASE WHEN p_type <> 'SMALL' THEN p_brand END AS config_hash,
         CASE WHEN p_size % 3 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS created
  FROM part)"""


def checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    """Checkpoint folders and files per run, from events."""
    return read_table(spark, sf, "events").select(
        F.concat(F.lit("run-"), F.col("user_id")).alias("run_id"),
        F.when(F.col("event_type") == "signup", "checkpoint-best")
        .when(F.col("event_type") == "error", F.concat(F.lit("log-"), F.col("event_id")))
        .otherwise(F.concat(F.lit("checkpoint-"), F.col("event_id")))
        .alias("name"),
        (F.col("event_type") != "view").alias("is_dir"),
        F.col("value").alias("eval_loss"),
    )


CHECKPOINTS = """(
  SELECT 'run-' || user_id AS run_id,
         CASE event_type WHEN 'signup' THEN 'checkpoint-best'
                         WHEN 'error' THEN 'log-' || event_id
                         ELSE 'checkpoint-' || event_id END AS name,
         event_type <> 'view' AS is_dir, value AS eval_loss, event_id
  FROM events)"""
