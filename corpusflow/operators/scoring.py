"""Batch inference, execution match and evaluation metrics."""

from __future__ import annotations

import hashlib
import sqlite3
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from corpusflow.functions import text as X
from corpusflow.operators.ordinal import head

# Prompts per model call, rows reported.
INFERENCE_BATCH = 16
REPORT_ROWS = 20

# Guards of the SQL sandbox: virtual machine steps and value size per statement.
SQL_STEPS = 20_000_000
SQL_VALUE_BYTES = 10_000_000
VARYING_FUNCTIONS = {
    "random", "randomblob", "changes", "total_changes", "last_insert_rowid", "date", "time", "datetime",
    "julianday", "unixepoch", "strftime", "timediff", "current_date", "current_time", "current_timestamp",
}
CACHED_CONTEXTS = 64
CACHED_RESULTS = 4_096


def predictor_udf(load: Callable[[], Callable], batch: int = INFERENCE_BATCH):
    """Arrow UDF from ``load() -> predict(list[str]) -> list[str]``; output is stripped.

    ``load`` runs once per Python worker task, the model is then used for all its
    batches.
    """

    @pandas_udf("string")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for prompts in batches:
            texts = prompts.tolist()
            out = []
            for start in range(0, len(texts), batch):
                out.extend(s.strip() for s in model(texts[start : start + batch]))
            yield pd.Series(out, index=prompts.index, dtype=object)

    return predict


def predict_batch(
    df: DataFrame,
    load: Callable[[], Callable],
    prompt: str = "prompt",
    output: str = "predicted",
    batch: int = INFERENCE_BATCH,
) -> DataFrame:
    """Add the generated text for every prompt."""
    return df.withColumn(output, predictor_udf(load, batch)(prompt))


def score_requests(
    df: DataFrame,
    load: Callable[[], Callable],
    question: str = "question",
    context: str = "context",
) -> DataFrame:
    """Answer valid requests with ``sql`` and ``prompt``; batch or streaming input.

    Rejected rows are those of :func:`corpusflow.operators.prepare.validate_requests`.
    """
    good = df.where(~X.is_blank(question) & ~X.is_blank(context))
    prompted = good.withColumn("prompt", X.format_prompt(question, context))
    return predict_batch(prompted, load, "prompt", "sql")


class _Recent(OrderedDict):
    """Keeps the entries used last."""

    def __init__(self, room: int):
        super().__init__()
        self.room = room

    def recall(self, key):
        self.move_to_end(key)
        return self[key]

    def keep(self, key, value):
        self[key] = value
        if len(self) > self.room:
            return self.popitem(last=False)[1]
        return None


class _Sandbox:
    """An empty in-memory database with the tables a context creates."""

    PLAIN = {
        sqlite3.SQLITE_SELECT,
        sqlite3.SQLITE_READ,
        sqlite3.SQLITE_FUNCTION,
        sqlite3.SQLITE_RECURSIVE,
    }
    FILE_PRAGMAS = {"temp_store_directory", "data_store_directory"}

    def __init__(self, ddl: Sequence[str], steps: int, value_bytes: int):
        self.db = sqlite3.connect(":memory:")
        self.changed = self.varying = self.exhausted = False
        self.db.setlimit(sqlite3.SQLITE_LIMIT_LENGTH, value_bytes)
        self.db.set_authorizer(self._allow)
        self.limit = steps
        try:
            for statement in ddl:
                self.digest(statement)
            self.db.commit()
        except BaseException:
            self.db.close()
            raise
        self.changed = False

    def _allow(self, action, first, second, database, trigger):
        if action in (sqlite3.SQLITE_ATTACH, sqlite3.SQLITE_DETACH):
            return sqlite3.SQLITE_DENY
        if action == sqlite3.SQLITE_PRAGMA and str(first).lower() in self.FILE_PRAGMAS:
            return sqlite3.SQLITE_DENY
        if action == sqlite3.SQLITE_FUNCTION and str(second).lower() in VARYING_FUNCTIONS:
            self.varying = True
        if action not in self.PLAIN:
            self.changed = True
        return sqlite3.SQLITE_OK

    def digest(self, sql: str) -> bytes:
        """A hash of the rows, read one by one: equal for equal lists of rows."""
        chunk = 10_000
        left = [max(1, self.limit // chunk)]
        self.varying = self.exhausted = False

        def tick():
            left[0] -= 1
            self.exhausted = left[0] < 0
            return self.exhausted

        self.db.set_progress_handler(tick, chunk)
        seen = hashlib.sha256()
        for row in self.db.execute(sql):
            seen.update(repr([_plain(v) for v in row]).encode("utf-8", "surrogatepass"))
        return seen.digest()


def _plain(value):
    """Equal numbers look alike: a float that is whole becomes a whole number."""
    return int(value) if isinstance(value, float) and value.is_integer() else value


def _fetcher(steps: int, value_bytes: int = SQL_VALUE_BYTES) -> Callable:
    """``fetch(ddl, sql)`` -> status and digest of the rows; results are remembered.

    The status is ``ok``, ``failed``, or ``limit`` for a statement that ran into a limit.
    """
    databases, results = _Recent(CACHED_CONTEXTS), _Recent(CACHED_RESULTS)

    def run(ddl: tuple, sql: str) -> tuple[tuple[str, bytes | None], bool]:
        box = databases.recall(ddl) if ddl in databases else None
        try:
            if box is None:
                box = _Sandbox(ddl, steps, value_bytes)
                dropped = databases.keep(ddl, box)
                if dropped is not None:
                    dropped.db.close()
            return ("ok", box.digest(sql)), box.varying
        except MemoryError:
            return ("limit", None), False
        except (sqlite3.Error, sqlite3.Warning, ValueError, OverflowError) as fault:
            limited = (box is not None and box.exhausted) or "too big" in str(fault)
            return ("limit" if limited else "failed", None), box is not None and box.varying
        finally:
            # A statement that may have changed the database does not share it.
            if box is not None and box.changed:
                databases.pop(ddl, None)
                box.db.close()

    def fetch(ddl, sql) -> tuple[str, bytes | None]:
        if ddl is None or sql is None:
            return "failed", None
        key = (tuple(ddl), sql)
        if key in results:
            return results.recall(key)
        found, varying = run(*key)
        if not varying:
            results.keep(key, found)
        return found

    return fetch


def execution_match(
    df: DataFrame,
    context: str = "context",
    predicted: str = "predicted",
    gold: str = "answer",
    output: str = "exec_match",
    steps: int = SQL_STEPS,
    value_bytes: int = SQL_VALUE_BYTES,
    status: str = "exec_status",
) -> DataFrame:
    """Add whether both queries return the same rows on the context's empty tables.

    Rows are compared in order, duplicates count, and a query that fails on either
    side is no match. ``status`` tells why: ``ok``, ``failed``, or ``limit`` where a
    statement took more than ``steps`` or a value over ``value_bytes``. Rows are read one
    by one into a digest, so a large result takes no memory. There is no shuffle: each task
    remembers recent results, so a context or query that fills a third of the table costs
    one run per task; what depends on chance or time is run anew. Statements may change
    their private database but cannot reach files.
    """

    @pandas_udf("verdict boolean, status string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        fetch = _fetcher(steps, value_bytes)
        for ddl, left, right in batches:
            verdicts, told = [], []
            for tables, a, b in zip(ddl, left, right):
                one, two = fetch(tables, a), fetch(tables, b)
                both = {one[0], two[0]}
                told.append("limit" if "limit" in both else "failed" if "failed" in both else "ok")
                verdicts.append(both == {"ok"} and one[1] == two[1])
            yield pd.DataFrame({"verdict": verdicts, "status": told}, index=left.index)

    judged = df.withColumn("_judged", judge(X.ddl_statements(context), F.col(predicted), F.col(gold)))
    return judged.withColumn(output, F.col("_judged.verdict")).withColumn(status, F.col("_judged.status")).drop("_judged")


def accuracy(flag: str | Column) -> Column:
    """Share of true rows among all rows; a null counts as false, no rows give null."""
    return F.avg(F.coalesce(F.col(flag) if isinstance(flag, str) else flag, F.lit(False)).cast("int"))


def exact_match_accuracy(df: DataFrame, predicted="predicted", gold="answer") -> DataFrame:
    return df.agg(accuracy(X.exact_match(predicted, gold)).alias("exact_match_accuracy"))


def execution_accuracy(df: DataFrame, flag="exec_match") -> DataFrame:
    return df.agg(accuracy(flag).alias("execution_accuracy"))


def evaluation_summary(
    df: DataFrame, exact="exact_match", executed="exec_match", run: str | None = "run_id", status="exec_status"
) -> DataFrame:
    """Both accuracies, the row count and the rows ``limited`` by a limit of the sandbox.

    One row per run (``run=None``: one in all). Without a ``status`` column none is limited.
    """
    told = F.count_if(F.col(status) == "limit") if status in df.columns else F.lit(0).cast("long")
    groups = [run] if run else []
    return df.groupBy(*groups).agg(
        accuracy(exact).alias("exact_match_accuracy"),
        accuracy(executed).alias("execution_accuracy"),
        F.count("*").alias("num_examples"),
        told.alias("limited"),
    )


def agreement_table(df: DataFrame, exact="exact_match", executed="exec_match") -> DataFrame:
    """Row count for every combination of the two verdicts that occurs."""
    return df.groupBy(exact, executed).agg(F.count("*").alias("rows"))


def example_report(
    df: DataFrame, keys: Sequence[str], n: int = REPORT_ROWS
) -> DataFrame:
    """The first examples with prediction, gold text and verdict."""
    return head(df, n, keys).select(
        "question",
        "predicted",
        F.col("answer").alias("gold"),
        X.exact_match("predicted", "answer").alias("exact_match"),
    )


def _groupable(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Columns in a form that can be grouped by: a map becomes its sorted entries."""
    return [
        F.array_sort(F.map_entries(c)).alias(c)
        if isinstance(df.schema[c].dataType, T.MapType)
        else F.col(c)
        for c in columns
    ]


def _by_place(df: DataFrame, ordinal: str | None) -> DataFrame:
    """Columns named by their place, ``ordinal`` first and under its name."""
    values = [F.col(f"`{c}`") for c in df.columns if c != ordinal]
    named = [c.alias(f"c{i}") for i, c in enumerate(values)]
    return df.select(*([ordinal] if ordinal else []), *named)


def same_result(
    spark, a: DataFrame | None, b: DataFrame | None, ordinal: str | None = "ord"
) -> DataFrame:
    """One row, ``same``: whether two result sets are equal; a failed one (None) never is.

    Rows are tuples: columns pair by place, whatever their names; only ``ordinal`` goes by
    name. With ``ordinal`` rows are paired by position. Without, they are compared as bags:
    both sides add up per distinct row before they meet, so repeated rows collapse
    ahead of the shuffle.
    """
    if a is None or b is None or len(a.columns) != len(b.columns):
        return spark.range(1).select(F.lit(False).alias("same"))
    a, b = (_by_place(x, ordinal) for x in (a, b))
    if ordinal:
        values = [c for c in a.columns if c != ordinal]
        left = a.select(ordinal, F.struct(*_groupable(a, values)).alias("_l"))
        right = b.select(ordinal, F.struct(*_groupable(b, values)).alias("_r"))
        paired = left.join(right, ordinal, "full")
        differs = paired.where(~F.col("_l").eqNullSafe(F.col("_r")))
    else:
        columns = a.columns
        both = a.select(*_groupable(a, columns), F.lit(1).alias("_n")).unionByName(
            b.select(*_groupable(b, columns), F.lit(-1).alias("_n"))
        )
        differs = both.groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return differs.agg((F.count("*") == 0).alias("same"))
