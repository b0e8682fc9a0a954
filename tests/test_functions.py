import base64
import re

import pytest
from pyspark.sql import functions as F

from corpusflow.functions import activity as A, state as S, text as X


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


SPACED = [
    "  SELECT  a\tFROM b \n",
    "\xa0x\x1c\x1d y\x85z ",
    "İstanbul ΟΔΟΣ",
    "",
    " 　 ",
    "a\x0bb\x0cc",
    "ab​c",
]


def test_normalize_and_strip_follow_python(spark):
    got = values(
        spark, [(s,) for s in SPACED], "s string", X.normalize_text("s"), X.strip_text("s")
    )
    assert got == [(re.sub(r"\s+", " ", s.lower().strip()), s.strip()) for s in SPACED]


def test_exact_match_counts_null_as_no_match(spark):
    rows = [("SELECT 1", " select\n1 "), ("a", "b"), (None, "a"), (None, None)]
    got = values(spark, rows, "p string, g string", X.exact_match("p", "g"))
    assert got == [(True,), (False,), (False,), (False,)]


def test_prompt_is_never_null(spark):
    got = values(
        spark, [("q", None), (None, "c")], "q string, c string", X.format_prompt("q", "c")
    )
    assert got == [
        ("translate English to SQL: q </s> Tables: None",),
        ("translate English to SQL: None </s> Tables: c",),
    ]


def test_ddl_statements_split_inside_literals_too(spark):
    context = " create table t (a text default 'x;CREATE y'); drop table t;\n Create view v "
    got = values(spark, [(context,)], "c string", X.ddl_statements("c"))
    assert got[0][0] == ["create table t (a text default 'x", "CREATE y')", "Create view v"]


@pytest.mark.parametrize(
    "log, payload",
    [
        ("x\n__RESULT_START__\nYWJj\n__RESULT_END__\n", b"abc"),
        ("__RESULT_START__\nYQ==\n__RESULT_END__\n__RESULT_START__\nYg==\n__RESULT_END__", b"a"),
        ("no markers", None),
        ("__RESULT_START__\nYWJj\n", None),
    ],
)
def test_marked_payload(spark, log, payload):
    got = values(spark, [(log,)], "t string", X.marked_payload("t"))[0][0]
    assert (bytes(got) if got is not None else None) == payload


def test_encoded_length_is_unbroken(spark):
    sizes = [0, 1, 2, 3, 300, 301]
    rows = [(bytes(n),) for n in sizes]
    got = values(spark, rows, "p binary", X.encoded_length("p"))
    assert [g[0] for g in got] == [len(base64.b64encode(bytes(n))) for n in sizes]


def test_percent_rounds_like_python(spark):
    numbers = [0.0625, 0.0035, 0.5, 1.0, 0.33333, 0.0625001, 0.12345, None]
    got = values(spark, [(v,) for v in numbers], "v double", X.percent("v"))
    assert [g[0] for g in got] == [None if v is None else f"{v * 100:.1f}%" for v in numbers]


def test_summary_and_names(spark):
    got = values(
        spark,
        [(0.49999, 0.5, "0123456789", 7)],
        "e double, x double, r string, v int",
        X.summary_text("e", "x"),
        X.quality_status("e"),
        X.quality_status("x"),
        X.short_id("r"),
        X.model_uri(F.lit("m"), "v"),
    )
    assert got == [
        (
            "Exact Match: 0.5000\nExecution Accuracy: 0.5000",
            "Warning",
            "Good",
            "01234567...",
            "models:/m/7",
        )
    ]


def test_last_segment(spark):
    rows = [("s3://b/x/run1",), ("s3://b/x/run1//",), ("plain",), ("",)]
    got = values(spark, rows, "p string", X.last_segment("p"))
    assert [g[0] for g in got] == ["run1", "run1", "plain", ""]


def test_config_fingerprint(spark):
    rows = [
        ("img", 1, "a100", ["b", "a"]),
        ("img", 1, "a100", ["a", "b"]),
        (None, None, None, None),
        ("img", 1, "a100", ["a,b"]),
        ("", 0, "any", ["é", "z", "Z"]),
    ]
    got = values(
        spark,
        rows,
        "i string, g int, t string, p array<string>",
        S.config_fingerprint("i", "g", "t", "p"),
    )
    # The first 16 digits of the SHA-256 of "img:1:a100:a,b", ":0:any:" and ":0:any:Z,z,é".
    first = "811b51cb9d659e87"
    assert [g[0] for g in got] == [first, first, "6287438fbc63ee18", first, "406656faeb9d2d7a"]


def test_bad_ports_do_not_end_the_job(spark):
    ports = ["F" * 16, "F" * 20, "xyz", "", "1F90", "f" * 15]
    rows = [(f"0: 0100007F:{p} 00000000:0000 0A",) for p in ports]
    got = values(spark, rows, "l string", A.tcp_fields("l").getField("port_number"))
    assert [g[0] for g in got] == [None, None, None, None, 8080, 16**15 - 1]


def test_bad_blocks_do_not_end_the_job(spark):
    logs = [f"__RESULT_START__\n{b}\n__RESULT_END__" for b in ("A", "!!==", "YWJj", "YW\nJj")] + ["none", None]
    got = values(spark, [(x,) for x in logs], "l string", X.marked_payload("l"), X.payload_fault("l"))
    assert [(None if p is None else bytes(p), f) for p, f in got] == [
        (None, "broken"),
        (None, "broken"),
        (b"abc", None),
        (b"abc", None),
        (None, None),
        (None, None),
    ]


def test_ttl_zero_is_the_only_one_left_out(spark):
    rows = [(0,), (None,), (600,)]
    assert values(spark, rows, "t int", S.pool_eligible("t")) == [(False,), (True,), (True,)]
    assert values(spark, rows, "t int", S.pool_eligible("t", enabled=False)) == [(False,)] * 3


def test_resource_ready(spark):
    rows = [("Running", "1.2.3.4"), ("Running", ""), ("Running", None), ("Pending", "1"), (None, "1")]
    got = values(spark, rows, "p string, a string", S.resource_ready("p", "a"))
    assert [g[0] for g in got] == [True, False, False, False, False]


def test_idle_seconds_reads_iso_text(spark):
    got = values(
        spark,
        [("2024-01-01T00:10:00.000001", "2024-01-01T00:00:00")],
        "n string, t string",
        S.idle_seconds("n", "t"),
    )
    assert got == [(600.000001,)]


TCP = [
    "  sl  local_address rem_address   st tx_queue rx_queue",
    "   0: 0100007F:0016 0200007F:C001 01 00000000:00000000",
    "   1: 0100007F:0016 0300007F:C002 01 00000000:00000000",
    "   2: 0100007F:1f90 0400007F:C003 01 00000000:00000000",
    "   3: 0100007F:0016 00000000:0000 0A 00000000:00000000",
    "   4: 0100007F:0016 00000000:0000",
    "   5: 0100007F0016 00000000:0000 01",
    "   6: 00:0016:9 00000000:0000 01",
    "   7: 00:16 00000000:0000 01",
    "",
]


def test_tcp_lines(spark):
    rows = [(t,) for t in TCP]
    fields = values(spark, rows, "l string", A.tcp_fields("l"))
    assert [tuple(f[0]) for f in fields] == [
        (None, None, None),
        ("0016", 22, "01"),
        ("0016", 22, "01"),
        ("1F90", 8080, "01"),
        ("0016", 22, "0A"),
        (None, None, None),
        (None, None, None),
        ("0016", 22, "01"),
        ("16", 22, "01"),
        (None, None, None),
    ]
    one_pattern = values(spark, rows, "l string", A.is_session("l"))
    assert [o[0] for o in one_pattern] == [
        f[0]["port"] == "0016" and f[0]["state"] == "01" for f in fields
    ]
    assert sum(v[0] for v in values(spark, rows, "l string", A.is_session("l", "1F90"))) == 1


def test_busy_and_items(spark):
    rows = [
        ('[{"id":"k1","execution_state":"busy"}]', "[]"),
        ('[{"id":"k1","execution_state":"idle"}]', '[{"name":"1"}]'),
        ("[]", "not json"),
        ('[{"id":"k1","execution_state":"busy"', None),
        (None, "[1]"),
    ]
    got = values(spark, rows, "k string, t string", A.any_busy("k"), A.any_item("t"))
    assert got == [(True, False), (False, True), (False, False), (False, False), (False, True)]


def test_checkpoint_step(spark):
    rows = [("checkpoint-1000",), ("checkpoint-best",), ("a-b-7",), ("none",)]
    got = values(spark, rows, "n string", S.checkpoint_step("n"))
    assert [g[0] for g in got] == [1000, None, 7, None]
