"""User functions over rows and batches, errors returned as data."""

from __future__ import annotations

import io
import traceback
from collections.abc import Callable, Iterator
from contextlib import redirect_stderr, redirect_stdout

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

CALL_FIELDS = "ok boolean, error string, traceback string, stdout string"


def _call(fn: Callable, values: dict):
    """Outcome of ``fn(**values)`` as a tuple in the order of the result columns."""
    out, err = io.StringIO(), io.StringIO()
    try:
        with redirect_stdout(out), redirect_stderr(err):
            value = fn(**values)
        return value, True, None, None, out.getvalue() + err.getvalue()
    except Exception as failure:
        return None, False, str(failure), traceback.format_exc(), out.getvalue() + err.getvalue()


def _checked(calls: list[tuple], dtype: pa.DataType) -> list[tuple]:
    """Turn calls whose value does not fit ``dtype`` into failed ones."""
    try:
        pa.array([c[0] for c in calls], type=dtype)
        return calls
    except (pa.ArrowException, TypeError, ValueError, OverflowError):
        pass
    checked = []
    for call in calls:
        try:
            pa.array([call[0]], type=dtype)
        except (pa.ArrowException, TypeError, ValueError, OverflowError) as failure:
            call = (None, False, str(failure), None, call[4])
        checked.append(call)
    return checked


def safe_map(
    df: DataFrame,
    fn: Callable,
    arguments: list[str],
    returns: str,
    keep: list[str] | None = None,
) -> DataFrame:
    """Call ``fn`` with the argument columns of each row, by name.

    Adds ``return_value``, ``ok``, ``error``, ``traceback`` and ``stdout`` (standard
    output, then standard error). A row whose call raises does not fail the job; a
    value that does not fit ``returns`` is a failed call too.
    """
    keep = df.columns if keep is None else keep
    kept = T.StructType([df.schema[c] for c in keep])
    extra = T._parse_datatype_string(f"return_value {returns}, {CALL_FIELDS}")
    names = [f.name for f in extra]
    dtype = to_arrow_type(extra["return_value"].dataType)
    wanted = list(dict.fromkeys([*keep, *arguments]))
    out = to_arrow_schema(extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(a).to_pylist() for a in arguments)) if arguments else [()] * batch.num_rows
            calls = _checked([_call(fn, dict(zip(arguments, r))) for r in rows], dtype)
            told = [pa.array([c[i] for c in calls], type=out.field(i).type) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *told], [*keep, *names])

    return df.select(*wanted).mapInArrow(run, T.StructType([*kept, *extra]))


def map_batches(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str | T.StructType,
    batch_size: int = 512,
    remove_columns: list[str] | None = None,
) -> DataFrame:
    """Apply ``fn`` to batches of at most ``batch_size`` rows, as they lie in ``df``.

    ``schema`` describes what ``fn`` adds; the columns of ``df`` are kept except
    ``remove_columns``, and are passed on as they are. If none is kept, ``fn`` may return
    any number of rows; else it must return one row per row. ``fn`` sees whole numbers
    with nulls among them as Python objects, not as floats.
    """
    gone = set(remove_columns or [])
    kept = [f for f in df.schema if f.name not in gone]
    added = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    names, out = [f.name for f in kept], to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                new = fn(part.to_pandas(integer_object_nulls=True))
                if names and len(new) != part.num_rows:
                    raise ValueError(f"{len(new)} rows for {part.num_rows}: remove all columns or keep the length")
                told = [pa.Array.from_pandas(new[f.name], type=f.type) for f in out]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *told], [*names, *out.names])

    return df.mapInArrow(run, T.StructType([*kept, *added]))
