"""Sums of outer products over vectors, the base of covariance and least squares."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import matrix


def outer_sums(df: DataFrame, vector: str) -> np.ndarray:
    """sum of z z^T with z = (vector, 1): one d x d partial per task, added by Spark; the result is as
    small as the square of the vector length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0), batch.num_rows)
                z = np.column_stack([x, np.ones(len(x))])
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "v"])

    rows = df.select(F.col(vector).cast("array<double>")).mapInArrow(run, "i bigint, j bigint, v double") \
        .groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    d = max((r["i"] for r in rows), default=-1) + 1
    out = np.zeros((d, d))
    for r in rows:
        out[r["i"], r["j"]] = r["v"]
    return out


def mean_and_cov(df: DataFrame, vector: str, ddof: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    s = outer_sums(df, vector)
    n = s[-1, -1]
    mu = s[-1, :-1] / n
    cov = (s[:-1, :-1] - n * np.outer(mu, mu)) / max(n - ddof, 1)
    return mu, cov, int(n)
