"""The same folds over streams: one state per key, rows of a batch in order, late rows refused rather than sorted in."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FoldProcessor(StatefulProcessor):
    """Runs a step function; a row with ``end_column`` true clears its key's state, and so does ``ttl_ms`` without a row."""

    def __init__(self, columns: list[str], order: list[str], start: Callable[[], Any], step: Callable, fields: list[str], end_column: str | None, ttl_ms: int | None, whole: list[str]) -> None:
        self.columns, self.order, self.start, self.step, self.fields, self.end, self.ttl, self.whole = columns, order, start, step, fields, end_column, ttl_ms, whole

    def init(self, handle: StatefulProcessorHandle) -> None:
        """Declares the state: one binary value."""
        self.state = handle.getValueState("fold", T.StructType([T.StructField("value", T.BinaryType())]), self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Folds a key's rows of this batch, in order."""
        held = self.state.get() if self.state.exists() else None
        state, out, ended = pickle.loads(bytes(held[0])) if held else self.start(), [], False
        batch = pd.concat(list(rows))
        for name in self.whole:
            batch[name] = pd.Series([None if v is None or v != v else int(v) for v in batch[name]], index=batch.index, dtype=object)
        for row in batch.sort_values(self.order).itertuples(index=False):
            values = tuple(None if not isinstance(v, (list, tuple)) and pd.isna(v) else v for v in (getattr(row, c) for c in self.columns))
            state, made = self.step(state, values)
            out += made
            ended = bool(self.end and getattr(row, self.end))
            if ended:
                state = self.start()
        if ended:
            self.state.clear()
        else:
            self.state.update((pickle.dumps(state),))
        yield pd.DataFrame(out, columns=self.fields, dtype=object)

    def close(self) -> None:
        """Nothing to close."""


def fold_stream(rows: DataFrame, key: str, order: list[str], start: Callable[[], Any], step: Callable, schema: T.StructType | str, end_column: str | None = None, ttl_ms: int | None = None) -> DataFrame:
    """The streaming form of :func:`veilframe.streaming.folds.fold_sorted`; needs the RocksDB state store.

    State of a key is dropped at a row whose ``end_column`` is true, and, with ``ttl_ms``, after so long without rows (processing time). A stream with
    ``ttl_ms`` goes on with batches without rows, so it ends with a trigger of one batch or by hand.
    """
    fields = (schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)).fieldNames()
    columns = [c for c in rows.columns if c != end_column]
    # As text, whole numbers beside missing values do not become floating-point numbers on their way.
    whole = [f.name for f in rows.schema if isinstance(f.dataType, T.LongType) and f.name != key]
    processor = FoldProcessor(columns, order, start, step, fields, end_column, ttl_ms, whole)
    return rows.withColumns({c: F.col(c).cast("string") for c in whole}).groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="processingTime" if ttl_ms else "none")


def by_lane(frames: DataFrame, lanes: dict[str, Callable[[DataFrame], DataFrame]], lane: str = "lane") -> DataFrame:
    """Each lane's rows through the transformation that is registered for it, in one frame; rows of other lanes are an error (L2).

    All transformations give the same columns. It is the same for batch and streaming frames.
    """
    known = F.col(lane).isin(*lanes)
    checked = frames.where(F.when(known, True).otherwise(F.raise_error(F.concat(F.lit("no analyzer for lane "), F.coalesce(F.col(lane), F.lit("null")))).cast("boolean")))
    return reduce(DataFrame.unionByName, (transform(checked.where(F.col(lane) == name)) for name, transform in lanes.items()))


def publish(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str, **trigger: Any) -> StreamingQuery:
    """A stream's decisions to several sinks, batch by batch (L4). A sink gets (rows, batch id); a batch that is run again has the same id,
    so a sink that writes under the id writes once.
    """

    def each(rows: DataFrame, batch: int) -> None:
        rows.persist()
        try:
            for sink in sinks:
                sink(rows, batch)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()
