"""Ordered folds by key, in batch: rows of a key in order through a state, one partition's keys after the other."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Step = Callable[[Any, tuple], tuple[Any, list[tuple]]]


def values_of(column: pa.Array) -> list:
    """Python's own values, as ``to_pylist`` gives them; numbers and lists of them without an object of Arrow's for each."""
    kind = column.type
    if pa.types.is_list(kind):
        inner, ends = values_of(column.values), column.offsets.to_pylist()
        made = [inner[a:b] for a, b in zip(ends, ends[1:])]
    elif pa.types.is_integer(kind) or pa.types.is_float64(kind) or pa.types.is_boolean(kind):
        zero = pa.scalar(False if pa.types.is_boolean(kind) else 0, kind)
        made = (column.fill_null(zero) if column.null_count else column).to_numpy(zero_copy_only=False).tolist()
    else:
        return column.to_pylist()
    for i in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)).tolist() if column.null_count else ():
        made[i] = None
    return made


def fold_sorted(rows: DataFrame, key: str, order: list[str | Column], start: Callable[[], Any], step: Step, schema: T.StructType | str, finish: Callable[[Any, Any], list[tuple]] | None = None) -> DataFrame:
    """``step(state, row)`` over each key's rows in order gives the next state and what comes out.

    Rows are dealt by key and sorted there, and pass in batches: a key with many rows needs the memory of its state, not of
    its rows. ``row`` is a tuple in the order of the columns, of Python's own values: whole numbers stay exact, missing values are None.
    ``finish(key, state)`` gives what comes out behind a key's last row.
    """
    wanted = to_arrow_schema(schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema))
    at = rows.columns.index(key)

    def made_of(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out) if out else [()] * len(wanted)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, wanted)], schema=wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun = object(), None, False
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*map(values_of, batch.columns)):
                if not begun or row[at] != now:
                    out += finish(now, state) if finish and begun else []
                    now, state, begun = row[at], start(), True
                state, made = step(state, row)
                out += made
            yield made_of(out)
        if finish and begun:
            yield made_of(finish(now, state))

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
