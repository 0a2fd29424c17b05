"""Arrow functions of Python values that hold few rows at a time.

A batch from the JVM has thousands of rows; as Python values the spans and texts of long documents would take hundreds of MB in
every worker, and a stage has a worker for each function in a row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows that are Python values at once.
ROWS = 256


def values(column: pa.Array) -> list:
    """As to_pylist; lists of structs, such as spans, are built from their fields, which is several times as fast."""
    kind = column.type
    if not (pa.types.is_list(kind) and pa.types.is_struct(kind.value_type)) or (flat := column.flatten()).null_count:
        return column.to_pylist()
    names = [f.name for f in kind.value_type]
    rows = [dict(zip(names, x, strict=True)) for x in zip(*(flat.field(k).to_pylist() for k in range(len(names))), strict=True)]
    out, at = [], 0
    for n in column.value_lengths().to_pylist():
        out.append(None if n is None else rows[at : at + n])
        at += n or 0
    return out


def sliced(kind: T.DataType, rows: int = ROWS) -> Callable:
    """Decorator: fn gets a list of values for each column, of at most so many rows, and returns as many values of kind."""

    def wrap(fn: Callable[..., Sequence]) -> Callable:
        def run(*columns: pa.Array) -> pa.Array:
            target = to_arrow_type(kind)
            parts = [pa.array(fn(*(values(c.slice(at, rows)) for c in columns)), target) for at in range(0, len(columns[0]), rows)]
            out = pa.concat_arrays(parts) if parts else pa.array([], target)
            del parts
            pa.default_memory_pool().release_unused()  # the other workers of the task need it
            return out

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        return F.arrow_udf(run, kind)

    return wrap
