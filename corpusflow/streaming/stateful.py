"""Rules that need event-time order, on Spark's state store.

Rows of a key wait in list state until the watermark has passed them and are then folded in
order; what the fold carries is value state, and an event-time timer wakes a key whose rows are
due, or whose carried state asks for it, also when it gets no more rows. Late rows are dropped
by the engine and counted in the query's progress (``numRowsDroppedByWatermark``).

The watermark moves only with rows. :func:`with_clock` adds a stream of instants to a feed, so
that the present goes on where no samples come: a rate source in service, a file in tests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TICK = "tick"
NO_SEQ = -(1 << 63)  # stands for a null ``seq`` in state: before all others

#: ``fold(carried, rows, mark)``: what was carried (nulls at first), rows of the state's schema in
#: order, the present in microseconds; gives the output rows, what is carried on, and when to wake
#: without rows (microseconds or None).
Fold = Callable[[tuple, list[tuple], int], tuple[list[tuple], tuple, int | None]]


def _cells(column: pd.Series) -> list:
    """Plain values with None for nulls; a group is small, so whole-column calls cost more than its rows."""
    return [None if v is pd.NaT or v is pd.NA or v != v else v for v in column.tolist()]


class InOrder(StatefulProcessor):
    """Fold the rows of each key once the watermark has passed them.

    ``held`` names the row's columns in state, the first two ``us`` (event time in
    microseconds) and ``seq``, which order the rows; ``carried`` is the state of the fold.
    """

    def __init__(self, key: str, held: str, carried: str, output: T.StructType, fold: Fold):
        self.key, self.held, self.carried, self.output, self.fold = key, held, carried, output, fold
        self.columns = [part.split()[0] for part in held.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.held)
        self.kept = handle.getValueState("kept", f"wake long, {self.carried}")
        self.nothing = (None,) * len(self.carried.split(", "))

    def _keep(self, was: int | None, at: int | None, carried: tuple) -> None:
        """Store what is carried, with one timer for the first millisecond after ``at``."""
        at = None if at is None else at // 1000 + 1
        if at != was:
            if was is not None:
                self.handle.deleteTimer(was)
            if at is not None:
                self.handle.registerTimer(at)
        self.kept.update((at, *carried))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            ticks = part[TICK].to_numpy(dtype=bool)
            if ticks.any():
                part = part[~ticks]
            if len(part):
                new = list(zip(*(_cells(part[c]) for c in self.columns)))
                self.rows.appendList([(int(us), int(seq), *more) for us, seq, *more in new])
                least = int(part["us"].min())
                first = least if first is None else min(first, least)
        if first is not None:
            wake, *carried = self.kept.get() or (None, *self.nothing)
            if wake is None or first // 1000 + 1 < wake:
                self._keep(wake, first, carried)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(self.rows.get(), key=lambda row: (row[0], row[1]))
        due = [row for row in held if row[0] < mark]
        rest = held[len(due) :]
        if rest and due:
            self.rows.put(rest)
        elif due:
            self.rows.clear()
        _, *carried = self.kept.get() or (None, *self.nothing)
        out, carried, later = self.fold(tuple(carried), due, mark)
        waits = [us for us in (rest[0][0] if rest else None, later) if us is not None]
        self._keep(None, min(waits, default=None), carried)
        if out:
            names = [f.name for f in self.output]
            yield pd.DataFrame([(*key, *row) for row in out], columns=names, dtype=object)

    def close(self) -> None:
        pass


def with_clock(feed: DataFrame, ts: str, clock: DataFrame | None) -> DataFrame:
    """The rows of a feed that have a time, and the instants ``ts`` of a stream ``clock`` as empty rows."""
    rows = feed.where(F.col(ts).isNotNull()).withColumn(TICK, F.lit(False))
    if clock is None:
        return rows
    ticks = clock.where(F.col(ts).isNotNull()).select(
        F.col(ts).cast("timestamp").alias(ts), F.lit(True).alias(TICK)
    )
    return rows.unionByName(ticks, allowMissingColumns=True)


def held_seq(seq: str = "seq") -> Column:
    """A tie-break without nulls, which a pandas column of integers cannot hold."""
    return F.coalesce(F.col(seq).cast("long"), F.lit(NO_SEQ)).alias(seq)


def in_order(rows: DataFrame, ts: str, delay_seconds: int, processor: InOrder) -> DataFrame:
    """Run a processor over a feed of :func:`with_clock`; state lies in RocksDB."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return (
        rows.withWatermark(ts, f"{delay_seconds} seconds")
        .groupBy(processor.key)
        .transformWithStateInPandas(processor, processor.output, "Append", "EventTime")
    )
