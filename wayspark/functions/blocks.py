"""Matrices of list columns, the first rows of keys, unions."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BYTES = 32 * 1024 * 1024


def matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    """(rows, d) doubles from a list column of equal lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(rows, -1) if rows else np.zeros((0, 1))


def best_rows(partial: DataFrame, key: str, order: list, k: int, place: str) -> DataFrame:
    """The ``k`` first rows of each key in ``order``, numbered from 0; tasks cut their own rows to ``k`` before the exchange."""
    w = Window.partitionBy(key).orderBy(*order)
    return partial.withColumn(place, F.row_number().over(w)).filter(F.col(place) <= k).withColumn(place, F.col(place) - 1)


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
