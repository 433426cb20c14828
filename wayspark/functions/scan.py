"""Ordered scans for rules that depend on the last kept row.

Rows are placed by key, sorted inside the partition and streamed through Arrow batches; only the
state of the open group is held, so a group of any length needs constant memory. Callers first cut
groups where the rule provably restarts, so that long groups spread over tasks. The number of
partitions is given, as these tasks are bound by work and not by bytes.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import partitions

AT_ONCE = 256               # rows of a batch that are Python objects at a time: a row may hold long arrays


def keep_scan(df: DataFrame, keys: list[str], order: list[str], columns: list[str],
              keep: Callable[[tuple, tuple], bool]) -> DataFrame:
    """Keep a row when it opens its group or ``keep(last_kept, row)`` holds on ``columns``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, last = None, None
        for batch in batches:
            ids = list(zip(*[batch.column(k).to_pylist() for k in keys]))
            rows = list(zip(*[batch.column(c).to_pylist() for c in columns]))
            flags = np.zeros(batch.num_rows, bool)
            for n, (key, row) in enumerate(zip(ids, rows)):
                if key != open_key or keep(last, row):
                    flags[n], open_key, last = True, key, row
            yield batch.filter(pa.array(flags))

    placed = df.repartition(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys, *order)
    return placed.mapInArrow(run, df.schema)


def group_scan(df: DataFrame, keys: list[str], order: list[str], columns: list[str],
               scanner: Callable[[], object], schema: T.StructType) -> DataFrame:
    """Feed each group, in order, to a fresh ``scanner()``.

    ``scanner.step(row)`` and ``scanner.close()`` yield output tuples without the keys; ``schema``
    describes the keys followed by those tuples.
    """
    types = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in schema.fields])

    def emit(rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), types)], schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, state, out = None, None, []
        for batch in batches:
            for first in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(first, AT_ONCE)
                ids = zip(*[part.column(k).to_pylist() for k in keys])
                rows = zip(*[part.column(c).to_pylist() for c in columns])
                for key, row in zip(ids, rows):
                    if key != open_key:
                        if state is not None:
                            out.extend((*open_key, *r) for r in state.close())
                        open_key, state = key, scanner()
                    out.extend((*key, *r) for r in state.step(row))
                if out:
                    yield emit(out)
                    out = []
        if state is not None:
            out.extend((*open_key, *r) for r in state.close())
        if out:
            yield emit(out)

    placed = df.select(*keys, *[c for c in dict.fromkeys([*order, *columns]) if c not in keys])
    placed = placed.repartition(partitions(df.sparkSession), *keys)
    return placed.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _arrow(t: T.DataType) -> pa.DataType:
    return {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "boolean": pa.bool_(),
            "int": pa.int32()}[t.simpleString()]
