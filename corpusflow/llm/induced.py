"""Suffix order of one shard by induced sorting, with its tuples in disk-backed queues.

A suffix is of type S if it is less than the next one, else of type L; an S suffix behind an
L suffix is starred. The stretch from a suffix to the next starred position, symbols marked
with their types, decides the order of two suffixes unless it is equal; then it ends at the
same depth in both, and the order of the two starred suffixes decides. So the starred
stretches are sorted and named, the string of names is solved by the same rule, and all
other suffixes are induced from the order of the starred ones.

All sorting goes through :class:`DiskQueue`: tuples are pushed in any order and popped in
ascending order; beyond ``limit`` tuples, sorted runs lie in files that have no name and end
with the task. The shard's symbols and one rank per position stay in memory.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

QUEUE_TUPLES = 4_000_000
BLOCK_TUPLES = 1 << 16


class DiskQueue:
    """A priority queue of number tuples of one width, popped in blocks."""

    def __init__(self, width: int, limit: int = QUEUE_TUPLES):
        self.width, self.limit = width, limit
        self.held: list[np.ndarray] = []
        self.size = 0
        self.runs: list = []

    def push(self, *columns: np.ndarray) -> None:
        self.held.append(np.stack([c.astype(np.int64) for c in columns]))
        self.size += len(columns[0])
        if self.size >= self.limit:
            self._spill()

    def _sorted(self) -> np.ndarray:
        rows = np.concatenate(self.held, axis=1) if self.held else np.zeros((self.width, 0), np.int64)
        return rows[:, np.lexsort(rows[::-1])]

    def _spill(self) -> None:
        file = tempfile.TemporaryFile()
        np.ascontiguousarray(self._sorted().T).tofile(file)
        file.seek(0)
        self.runs.append(file)
        self.held, self.size = [], 0

    def pop_all(self) -> Iterator[np.ndarray]:
        """All tuples in order, as blocks of columns."""
        if not self.runs:
            yield self._sorted()
            return
        if self.size:
            self._spill()
        fronts = [self._read(file) for file in self.runs]
        while any(f.shape[1] for f in fronts):
            ends = [tuple(f[:, -1]) for f in fronts if f.shape[1]]
            bound = min(ends)
            due = []
            for k, front in enumerate(fronts):
                n = self._up_to(front, bound)
                due.append(front[:, :n])
                fronts[k] = front[:, n:] if n < front.shape[1] else self._read(self.runs[k])
            rows = np.concatenate(due, axis=1)
            yield rows[:, np.lexsort(rows[::-1])]

    def _read(self, file) -> np.ndarray:
        block = file.read(BLOCK_TUPLES * self.width * 8)
        return np.frombuffer(block, np.int64).reshape(-1, self.width).T

    @staticmethod
    def _up_to(rows: np.ndarray, bound: tuple) -> int:
        less, equal = np.zeros(rows.shape[1], bool), np.ones(rows.shape[1], bool)
        for column, value in zip(rows, bound):
            less |= equal & (column < value)
            equal &= column == value
        return int((less | equal).sum())


def _refined(groups: np.ndarray, keys: np.ndarray, limit: int) -> np.ndarray:
    """New group numbers for elements with old ones and keys.

    A group's number is the number of elements that are less than its own, so refining a
    group changes no other.
    """
    queue = DiskQueue(3, limit)
    for a in range(0, len(groups), BLOCK_TUPLES * 16):
        b = min(len(groups), a + BLOCK_TUPLES * 16)
        queue.push(groups[a:b], keys[a:b], np.arange(a, b))
    out = np.empty(len(groups), np.int64)
    at, last, begun, first = 0, None, 0, 0
    for group, key, index in queue.pop_all():
        if not len(group):
            continue
        new_group = np.ones(len(group), bool)
        new_group[1:] = group[1:] != group[:-1]
        new_key = new_group.copy()
        new_key[1:] |= key[1:] != key[:-1]
        if last is not None:
            new_group[0] = group[0] != last[0]
            new_key[0] = new_group[0] or key[0] != last[1]
        place = np.arange(at, at + len(group))
        starts = np.maximum.accumulate(np.where(new_group, place, begun))
        firsts = np.maximum.accumulate(np.where(new_key, place, first))
        out[index] = group + firsts - starts
        at, last, begun, first = at + len(group), (group[-1], key[-1]), starts[-1], firsts[-1]
    return out


def _stretch_groups(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int) -> np.ndarray:
    """Groups of equal stretches, numbered in their order."""
    bits = int(symbols.max()).bit_length()
    fit = max(1, 62 // bits)
    groups = np.zeros(len(starts), np.int64)
    active, done = np.arange(len(starts)), 0
    while len(active):
        key = np.zeros(len(active), np.int64)
        for k in range(done, done + fit):
            at = starts[active] + k
            inside = at <= ends[active]
            key = (key << bits) | np.where(inside, symbols[np.minimum(at, ends[active])], 0)
        groups[active] = _refined(groups[active], key, limit)
        done += fit
        _, number, size = np.unique(groups[active], return_inverse=True, return_counts=True)
        active = active[(size[number] > 1) & (starts[active] + done <= ends[active])]
    return groups


def suffix_ranks(text: np.ndarray, wanted: np.ndarray | None = None, limit: int = QUEUE_TUPLES) -> np.ndarray:
    """Ranks of the suffixes at ``wanted`` (all, if None) among these.

    ``text`` holds whole numbers and ends with its only 0.
    """
    n = len(text)
    if wanted is None:
        wanted = np.arange(n)
    if n == 1:
        return np.zeros(len(wanted), np.int64)
    step = np.sign(text[1:] - text[:-1])
    turns = np.flatnonzero(step)
    is_s = np.empty(n, bool)
    is_s[:-1] = step[turns[np.searchsorted(turns, np.arange(n - 1))]] > 0
    is_s[-1] = True
    star = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    symbols = 2 * text + is_s

    def ends(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        following = np.minimum(np.searchsorted(star, starts, "right"), len(star) - 1)
        return star[following], following

    star_ends, _ = ends(star)
    names = _stretch_groups(symbols, star, star_ends, limit)
    distinct, dense = np.unique(names, return_inverse=True)
    star_ranks = dense if len(distinct) == len(star) else suffix_ranks(dense, None, limit)
    wanted_ends, following = ends(wanted)
    groups = _stretch_groups(symbols, wanted, wanted_ends, limit)
    return _refined(groups, star_ranks[following], limit)


def common_prefixes(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Common prefixes, up to ``most`` bytes, of the suffixes at ``a`` and ``b`` (both have as many)."""
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    found = np.zeros(len(a), np.int64)
    active = np.arange(len(a))
    for depth in [*range(0, most - 7, 8), *([most - 8] if most % 8 else [])]:
        same = words[a[active] + depth] == words[b[active] + depth]
        active = active[same]
        found[active] = depth + 8
    return found
