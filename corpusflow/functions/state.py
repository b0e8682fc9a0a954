"""Expressions over execution configs, resources, checkpoints and instants."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpusflow.functions.text import _col


def config_fingerprint(image, gpu, gpu_type, packages) -> Column:
    """First 16 hex digits of the SHA-256 of the parts that decide reuse.

    Missing parts take their defaults; packages are sorted by code point, repeated ones stay.
    Separators are not escaped, so a package named ``a,b`` equals ``a`` plus ``b``.
    """
    names = F.coalesce(_col(packages), F.array().cast("array<string>"))
    text = F.concat_ws(
        ":",
        F.coalesce(_col(image), F.lit("")),
        F.coalesce(_col(gpu), F.lit(0)).cast("string"),
        F.coalesce(_col(gpu_type), F.lit("any")),
        F.concat_ws(",", F.array_sort(names)),
    )
    return F.substring(F.sha2(text, 256), 1, 16)


def sorted_items(items) -> Column:
    """Array sorted by code point."""
    return F.array_sort(_col(items))


def pool_eligible(ttl, enabled: bool = True) -> Column:
    """Pooled when the pool is on and ``ttl`` is not zero; no ``ttl`` means pooled."""
    return F.lit(enabled) & F.coalesce(_col(ttl) != 0, F.lit(True))


def resource_ready(phase, address) -> Column:
    """Running and reachable."""
    return F.coalesce((_col(phase) == "Running") & (_col(address) != ""), F.lit(False))


def checkpoint_step(name) -> Column:
    """Whole number after the last dash; null when it is not one."""
    return F.substring_index(_col(name), "-", -1).try_cast("long")


def micros(ts) -> Column:
    """Instant as microseconds; zone-less timestamps count as session time (UTC)."""
    return F.unix_micros(_col(ts).cast("timestamp"))


def idle_seconds(now, since) -> Column:
    """Seconds from ``since`` to ``now``; ISO text is accepted for either."""
    return (micros(now) - micros(since)) / F.lit(1_000_000.0)
