"""Whole groups from sorted Arrow streams, many at a time, so that small groups cost no call each."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table, edges): tables of complete groups and where each begins, with the end; only the last group of a batch is held back."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        key = [table.column(k).to_numpy() for k in keys]
        new = np.zeros(table.num_rows, bool)
        for k in key:
            new[1:] |= k[1:] != k[:-1]
        edges = np.append(0, np.flatnonzero(new))
        if len(edges) > 1:
            yield table.slice(0, edges[-1]), edges
        held = table.slice(edges[-1])
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])
