import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from corpusflow.llm import chat

TURNS = "conv_id long, turn long, role string, text string, formatted string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    by = {}
    for conv, turn, role, text, *_ in rows:
        by.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out


ROWS = [
    (1, 0, "system", "be kind"),
    (1, 1, "user", "a <| b <\\| c <\\\\|"),
    (1, 2, "user", "again<"),
    (1, 3, "assistant", "|im_end|>\nyes <|im_sep|> no"),
    (1, 4, "assistant", ""),
    (2, 1, "assistant", None),
    (2, 0, None, "first"),
    (None, None, "us\ner<\\n|", "x"),
    (None, 1, "assistant", "字" * 500),
    (3, 1, "assistant", "same"),
    (3, 1, "assistant", "same"),
    (3, 1, "user", "same"),
    (4, 0, "<n|", "l" * 100_000),
]


def test_read_back(spark):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], TURNS).repartition(3)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.chat_digest(df).collect()}
    probe = [(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]
    assert got == expected(ROWS + probe)


def test_format_and_mask(spark):
    df = spark.createDataFrame([(*r, "") for r in ROWS], TURNS)
    for row in chat.format_chats(df).collect():
        assert sum(sum(run) for run in row.loss_runs) == len(row.formatted)
        assert len(re.findall(r"<\|im_start\|>", row.formatted)) == len(re.findall(r"<\|im_end\|>\n", row.formatted))
        roles = re.findall(r"<\|im_start\|>([^\n]*)\n", row.formatted)
        assert all(a != b for a, b in zip(roles, roles[1:]))  # adjacent turns of one role are one message
        at, loss = 0, ""
        for run in row.loss_runs:
            loss += row.formatted[at + run.skip : at + run.skip + run.take]
            at += run.skip + run.take + run.tail
        assert "<|" not in loss


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from(["user", "assistant", "a<\\n|\n"]), st.text("<|\\n\n im_endsep>é", max_size=12)), min_size=1, max_size=25))
def test_any_text(spark, turns):
    rows = [(c, k, r, t, "") for k, (c, r, t) in enumerate(turns)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.chat_digest(spark.createDataFrame(rows, TURNS)).collect()}
    got.pop(-1)
    assert got == expected(rows)


def test_no_rows(spark):
    assert [r.conv_id for r in chat.chat_digest(spark.createDataFrame([], TURNS)).collect()] == [-1]
    assert chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0


@pytest.mark.parametrize("name", ["MapInArrow", "ArrowEvalPython", "BatchEvalPython", "FlatMapGroups"])
def test_native(spark, name):
    df = chat.chat_digest(spark.createDataFrame([], TURNS))
    assert name not in df._jdf.queryExecution().executedPlan().toString()
