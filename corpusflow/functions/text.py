"""Text expressions for prompts, matching, SQL context and paths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# The prompt wording.
PROMPT_HEAD = "translate English to SQL: "
PROMPT_TABLES = " </s> Tables: "

# The lines around an encoded result in a log.
RESULT_START = "__RESULT_START__"
RESULT_END = "__RESULT_END__"

# Unicode white space plus the four ASCII separators the Java class leaves out.
SPACE = r"[\s\x1c-\x1f]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_text(c) -> Column:
    """Remove white space at both ends."""
    return F.regexp_replace(_col(c), rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def normalize_text(c) -> Column:
    """Lower-case, strip, and turn every white-space run into one blank."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), rf"(?U){SPACE}+", " "))


def exact_match(predicted, gold) -> Column:
    """True when both texts are equal after :func:`normalize_text`; null never matches."""
    return F.coalesce(normalize_text(predicted) == normalize_text(gold), F.lit(False))


def format_prompt(question, context) -> Column:
    """Prompt text; a missing part is spelled ``None`` and the prompt is never null."""
    none = F.lit("None")
    return F.concat(
        F.lit(PROMPT_HEAD),
        F.coalesce(_col(question), none),
        F.lit(PROMPT_TABLES),
        F.coalesce(_col(context), none),
    )


def is_blank(c) -> Column:
    """True for null, empty and all-white-space text."""
    return F.coalesce(strip_text(c), F.lit("")) == ""


def ddl_statements(context) -> Column:
    """Pieces of ``context`` between semicolons that start with CREATE, any case."""
    pieces = F.transform(F.split(_col(context), ";"), strip_text)
    return F.filter(pieces, lambda s: F.upper(s).startswith("CREATE"))


def last_segment(path) -> Column:
    """Last part of a path, ignoring slashes at its end."""
    return F.substring_index(F.regexp_replace(_col(path), r"/+\z", ""), "/", -1)


def marked_payload(text) -> Column:
    """Bytes of the first base64 block between the result markers; null without a good one."""
    block = _marked_block(text)
    return F.try_to_binary(F.when(block != "", block), F.lit("base64"))


def _marked_block(text) -> Column:
    return F.regexp_extract(_col(text), rf"(?s){RESULT_START}\n(.*?)\n{RESULT_END}", 1)


def payload_fault(text) -> Column:
    """``broken`` when the markers hold a block that is not base64; else null."""
    block = _marked_block(text)
    return F.when((block != "") & marked_payload(text).isNull(), "broken")


def encoded_length(payload) -> Column:
    """Length of the payload as unbroken base64 text, without encoding it."""
    return (F.ceil(F.octet_length(_col(payload)) / 3) * 4).cast("long")


def quality_status(accuracy) -> Column:
    """``Good`` from one half upward, else ``Warning``."""
    return F.when(_col(accuracy) >= 0.5, "Good").otherwise("Warning")


def short_id(run_id) -> Column:
    return F.concat(F.substring(_col(run_id), 1, 8), F.lit("..."))


def model_uri(name, version) -> Column:
    return F.concat(
        F.lit("models:/"), _col(name), F.lit("/"), _col(version).cast("string")
    )


def _spelled(values: pd.Series, form: str) -> pd.Series:
    texts = [None if pd.isna(v) else form.format(v) for v in values]
    return pd.Series(texts, index=values.index, dtype=object)


@pandas_udf(StringType())
def _percent(values: pd.Series) -> pd.Series:
    return _spelled(values * 100, "{:.1f}%")


@pandas_udf(StringType())
def _four_digits(values: pd.Series) -> pd.Series:
    return _spelled(values, "{:.4f}")


def percent(value) -> Column:
    """``value`` as a percentage with one digit, rounded on its exact binary value.

    The built-in formatters round the printed decimal half up, so this stays in
    Python; it is meant for metric tables, which hold one row per run.
    """
    return _percent(_col(value).cast("double"))


def summary_text(exact, executed) -> Column:
    """Two-line summary of both accuracies, four digits each."""
    return F.concat(
        F.lit("Exact Match: "),
        _four_digits(_col(exact).cast("double")),
        F.lit("\nExecution Accuracy: "),
        _four_digits(_col(executed).cast("double")),
    )
