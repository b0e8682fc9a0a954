"""Expressions that read activity samples: kernel lists, terminals, TCP tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from corpusflow.functions.text import SPACE, _col, strip_text

# Port 22 and the established state as the TCP table spells them.
SSH_PORT = "0016"
ESTABLISHED = "01"

_KERNELS = "array<struct<id:string,execution_state:string>>"


def any_busy(kernels) -> Column:
    """True when a JSON kernel list holds a busy kernel; broken JSON is not busy."""
    parsed = F.from_json(_col(kernels), _KERNELS)
    return F.coalesce(
        F.exists(parsed, lambda k: k["execution_state"] == "busy"), F.lit(False)
    )


def any_item(items) -> Column:
    """True when a JSON array is not empty; broken JSON counts as empty."""
    return F.coalesce(F.json_array_length(_col(items)) > 0, F.lit(False))


def responded(status) -> Column:
    return F.coalesce(_col(status) == 200, F.lit(False))


def tcp_fields(line) -> Column:
    """``port`` (hex text), ``port_number`` and ``state`` of a TCP table line.

    All null when the line has fewer than four fields or no port in the second; the
    number is null when the port is not hexadecimal or does not fit.
    """
    parts = F.split(strip_text(line), rf"(?U){SPACE}+")
    usable = (F.size(parts) >= 4) & F.contains(F.get(parts, 1), F.lit(":"))
    port = F.upper(F.get(F.split(F.get(parts, 1), ":"), 1))
    return F.struct(
        F.when(usable, port).alias("port"),
        F.when(usable & F.rlike(port, F.lit(r"\A[0-9A-F]{1,15}\z")), F.conv(port, 16, 10).cast("long")).alias(
            "port_number"
        ),
        F.when(usable, F.get(parts, 3)).alias("state"),
    )


def is_session(line, port: str = SSH_PORT, state: str = ESTABLISHED) -> Column:
    """True for an established connection on ``port``; both compare as hex text.

    One pattern instead of :func:`tcp_fields`, so a line is scanned once at most.
    """
    word, colonless = r"[^\s\x1c-\x1f]", r"[^\s\x1c-\x1f:]"
    pattern = (
        rf"(?U)\A{SPACE}*{word}+{SPACE}+{colonless}*:(?i:{re.escape(port)})(?::{word}*)?{SPACE}+"
        rf"{word}+{SPACE}+{re.escape(state)}(?:{SPACE}|\z)"
    )
    return F.coalesce(F.rlike(_col(line), F.lit(pattern)), F.lit(False))
