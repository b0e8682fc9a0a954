"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

Texts are joined with a byte that belongs to no word and taken in chunks of bounded size; a
longer text is a chunk of its own. Hashes of words and word runs come from running sums of a
polynomial modulo 2^64 whose base is odd, so that a run's sum can be shifted back to 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK_BYTES = 1 << 20
BREAK = b"\n"
# An odd base and its inverse modulo 2^64, and the splitmix64 finalizer.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

_powers = {BASE: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        factors = np.full(max(n, 1 << 16), base, np.uint64)
        factors[0] = 1
        _powers[base] = np.multiply.accumulate(factors)
    return _powers[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sums(values: np.ndarray) -> np.ndarray:
    """Running sums of ``values[i] * BASE^i``, from 0."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def run_hashes(running: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the runs from ``starts`` to ``ends``, wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    return mixed((running[ends] - running[starts]) * powers(INVERSE, len(running))[starts])


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` entries."""
    starts = np.arange(max(0, len(hashes) - n + 1))
    return run_hashes(sums(hashes), starts, starts + n)


class Words:
    """The words of some texts: bytes ``data``, ``starts``, ``ends`` and text number ``doc``."""

    def __init__(self, texts: list[bytes], word_bytes: np.ndarray):
        self.buffer = BREAK.join(texts)
        self.data = np.frombuffer(self.buffer, np.uint8)
        inside = np.zeros(len(self.data) + 2, np.int8)
        inside[1:-1] = word_bytes[self.data]
        edges = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
        self.doc = np.searchsorted(begins, self.starts, "right") - 1
        self.count = np.bincount(self.doc, minlength=len(texts))

    def hashes(self) -> np.ndarray:
        return run_hashes(sums(self.data.astype(np.uint64) + np.uint64(1)), self.starts, self.ends)

    def joined(self, start: int, n: int) -> bytes:
        """``n`` words from word ``start`` on, with single spaces."""
        return b" ".join(
            self.buffer[a:b] for a, b in zip(self.starts[start : start + n], self.ends[start : start + n])
        )


def byte_class(excluded: list[tuple[int, int]]) -> np.ndarray:
    """True for each byte outside the given ranges, ends included."""
    found = np.ones(256, bool)
    for low, high in excluded:
        found[low : high + 1] = False
    return found


def texts_of(column) -> list[bytes]:
    """An Arrow text column as UTF-8; null is empty."""
    import pyarrow as pa

    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Row ranges of at most CHUNK_BYTES, one row at least."""
    first, held = 0, 0
    for k, text in enumerate(texts):
        if k > first and held + len(text) > CHUNK_BYTES:
            yield first, k
            first, held = k, 0
        held += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


PORTION_BYTES = 1 << 23


def portions(batch, column: str = "text") -> Iterator[tuple[list[bytes], object]]:
    """A batch in slices of at most PORTION_BYTES of text, one row at least, with their texts."""
    texts = texts_of(batch.column(column))
    first, held = 0, 0
    for k, text in enumerate(texts):
        if k > first and held + len(text) > PORTION_BYTES:
            yield texts[first:k], batch.slice(first, k - first)
            first, held = k, 0
        held += len(text)
    if first < len(texts):
        yield texts[first:], batch.slice(first)
