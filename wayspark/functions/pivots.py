"""Exact neighbours and counts by pivots: rows are sorted into the cells of drawn pivots, and a query meets only the cells
that the triangle inequality leaves.

A cell holds the rows whose nearest pivot it is, and knows how many they are and how far the farthest lies (its radius). With d the distance of
a query to the pivot, every row of the cell is at least d - radius and at most d + radius away. So against a bound that the query brings (its k-th
distance in the cells around it, or the distance of its own row) a cell is skipped, counted whole, or compared row by row. Neighbouring cells
share a block; only queries are copied, once for each block that has cells left for them, and meet these cells alone. A cell above ``BLOCK_BYTES``
is cut into parts that each see its queries, and crowded queries of a block likewise. Pivots are a seeded draw of at most ``PIVOTS`` rows; they and the
cells' figures are all that the driver sees and that is broadcast. The draw decides the cost only. Rows without structure (all about as
far from each other) leave all cells: then every query goes to every block, and all pairs are compared.

An index may hold, instead of the rows, shorter vectors whose distance never exceeds the rows' (``embed``); then nothing is counted whole.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, partitions
from .blocks import BLOCK_BYTES, matrix

PIVOTS = 1024
PIVOT_BYTES = 32 * 1024 * 1024
LEAST_BYTES = 1024 * 1024      # of a block: more tasks than that would copy queries for nothing
STEP = 4_000_000            # distances in memory
CELL_BYTES = 24             # of a query's cell in a task: listed, and named by number and row


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
    return np.sqrt(np.maximum(d2, 0.0))


def angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The angle between directions; a zero vector is at a right angle to all."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return np.arccos(np.clip(unit(a) @ unit(b).T, -1.0, 1.0))


def largest_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.abs(a[:, None, :] - b[None, :, :]).max(axis=2, initial=0.0)


def _slices(rows: int, width: int) -> Iterator[slice]:
    step = max(1, STEP // max(1, width))
    return (slice(lo, lo + step) for lo in range(0, rows, step))


def _lists(mask: np.ndarray) -> pa.Array:
    """The marked columns of every row."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(mask.sum(1))), pa.int32()), pa.array(np.nonzero(mask)[1].astype(np.int16)))


class PivotIndex:
    """``rows`` by cells. ``embed`` names the column of vectors that ``metric`` compares; ``slack`` covers its rounding, in its unit.
    Each query is copied to the blocks it meets: where queries are wide and many, ``least_bytes`` keeps blocks few."""

    def __init__(self, rows: DataFrame, embed: str, metric: Callable[[np.ndarray, np.ndarray], np.ndarray], row_bytes: int, slack: float = 1e-6, pivots: int | None = None,
                 least_bytes: int = LEAST_BYTES):
        self.embed, self.metric, self.slack, self.columns = embed, metric, slack, rows.columns
        self.spark = rows.sparkSession
        rows = cut_lineage(rows)
        self.n = rows.count()
        first = rows.select(F.size(embed)).first()
        self.width = max(1, first[0] if first else 1)
        most = max(1, min(PIVOTS, PIVOT_BYTES // (8 * self.width)))
        wanted = pivots or min(most, max(1, math.isqrt(self.n)))
        drawn = rows.select(F.col(embed).alias("p")).orderBy(F.xxhash64("p")).limit(wanted).collect()
        self.pivots = np.array([r["p"] for r in drawn], float).reshape(len(drawn), self.width)
        spot, distance = self.spark.sparkContext.broadcast(self.pivots), metric

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(embed), batch.num_rows)
                cell, far = np.zeros(len(x), np.int32), np.zeros(len(x))
                for s in _slices(len(x), spot.value.size):
                    d = distance(x[s], spot.value)
                    cell[s] = d.argmin(1)
                    far[s] = d.min(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "_cell", "_far"])

        kinds = T.StructType([*rows.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_far", T.DoubleType())])
        self.spot = spot
        self.rows = cut_lineage(rows.mapInArrow(assign, kinds)) if self.n else rows.withColumns({"_cell": F.lit(0), "_far": F.lit(0.0)})
        self.count, self.radius = np.zeros(len(drawn), np.int64), np.zeros(len(drawn))
        for r in self.rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_far").alias("r")).collect():
            self.count[r["_cell"]], self.radius[r["_cell"]] = r["n"], r["r"]
        # neighbouring cells, in the order of their pivots along the widest axis, fill a block; enough blocks for all cores
        axis = np.zeros(len(drawn))
        if len(drawn) > 1:
            axis = (self.pivots - self.pivots.mean(0)) @ np.linalg.svd(self.pivots - self.pivots.mean(0), full_matrices=False)[2][0]
        room = min(BLOCK_BYTES, max(least_bytes, self.n * row_bytes // partitions(self.spark)))
        self.block, held, at = np.zeros(len(drawn), np.int64), 0, 0
        for cell in np.argsort(axis, kind="stable"):
            size = int(self.count[cell]) * row_bytes
            if held and held + size > room:
                held, at = 0, at + 1
            self.block[cell] = at
            held += size
        sizes = np.bincount(self.block, self.count, minlength=1) * row_bytes
        self.parts = np.maximum(1, np.ceil(sizes / BLOCK_BYTES)).astype(np.int64)

    def _cells(self, queries: DataFrame, choose: Callable, bound: str | None, skip: str | None, extra: list[T.StructField]) -> DataFrame:
        """``queries`` with the columns of ``choose(distances, bounds, skipped)``; the first are lists of cells."""
        spot, distance, embed = self.spot, self.metric, self.embed
        kinds = T.StructType([*queries.schema.fields, *extra])
        wide = max(1, self.pivots.size)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for s in _slices(whole.num_rows, wide):
                    batch = whole.slice(s.start, s.stop - s.start)
                    x = matrix(batch.column(embed), batch.num_rows)
                    u = batch.column(bound).to_numpy() if bound else None
                    seen = batch.column(skip).to_pylist() if skip else None
                    added = choose(distance(x, spot.value) if len(spot.value) else np.zeros((len(x), 0)), u, seen)
                    yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *[f.name for f in extra]])
        return queries.mapInArrow(run, kinds)

    def home(self, queries: DataFrame, k: int) -> DataFrame:
        """``queries`` with ``_cells``: the nearest cells that hold ``k`` rows together."""
        count = self.count

        def choose(d, _, __):
            order = np.argsort(np.where(count > 0, d, np.inf), axis=1, kind="stable")
            before = np.cumsum(count[order], axis=1) - count[order]
            mask = np.zeros(d.shape, bool)
            np.put_along_axis(mask, order, (before < k) & (count[order] > 0), axis=1)
            return [_lists(mask)]
        return self._cells(queries, choose, None, None, [T.StructField("_cells", T.ArrayType(T.ShortType()))])

    def around(self, queries: DataFrame, bound: str, skip: str | None = None, whole: bool = False) -> DataFrame:
        """``queries`` with ``_cells``: the cells that may hold rows within ``bound``, without those of ``skip``; and ``_sure``, the number of rows of cells
        that lie within it altogether (with ``whole``; such cells are not listed)."""
        count, radius, slack = self.count, self.radius, self.slack

        def choose(d, u, seen):
            room = slack * (1.0 + np.abs(u))[:, None]
            mask = (count > 0) & (d - radius <= u[:, None] + room)
            inside = mask & (d + radius < u[:, None] - room) if whole else np.zeros_like(mask)
            for row, cells in enumerate(seen or ()):
                mask[row, cells] = False
            return [_lists(mask & ~inside), pa.array((inside * count).sum(1))]
        return self._cells(queries, choose, bound, skip, [T.StructField("_cells", T.ArrayType(T.ShortType())), T.StructField("_sure", T.LongType())])

    def compared(self, queries: DataFrame) -> int:
        """Pairs of a query and a row that the cells of ``queries`` leave."""
        own = F.explode("_cells").alias("c")
        return sum(int(self.count[r["c"]]) * r["n"] for r in queries.select(own).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect())

    def compare(self, queries: DataFrame, fn: Callable[[pa.Table, pa.Table], dict], schema: str, query_bytes: int) -> DataFrame:
        """``fn(queries of a cell, rows of the cell)`` over the cells of every query, as one table of partial results."""
        names = [c for c in queries.columns if c not in ("_cells", "_sure")], self.columns
        of = F.array(*[F.lit(int(b)) for b in self.block] or [F.lit(0)])
        home = lambda cell: F.element_at(of, cell + 1)
        asked = queries.withColumn("_block", F.explode(F.array_distinct(F.transform("_cells", home)))).select(
            *names[0], "_block", F.filter("_cells", lambda c: home(c) == F.col("_block")).alias("_cells"))
        tasks = partitions(self.spark)
        crowd = asked.groupBy("_block").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("_cells")).alias("cells")).collect()       # at most one row a block
        parts, shares = self.parts, np.ones(len(self.parts), np.int64)
        for r in crowd:
            held = r["n"] * query_bytes + r["cells"] * CELL_BYTES
            # few blocks: their queries are shared out for all cores
            shares[r["_block"]] = max(1, -(-held // BLOCK_BYTES), min(tasks // max(1, len(crowd)), held // LEAST_BYTES))
        at = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("_block") + 1)
        deal = lambda values: F.pmod(F.xxhash64(F.monotonically_increasing_id()), at(values)).cast("int")
        every = lambda values: F.explode(F.sequence(F.lit(0), at(values) - 1))
        left = asked.withColumn("_share", F.pmod(F.xxhash64(*names[0][:1]), at(shares)).cast("int")).withColumn("_part", every(parts))
        right = self.rows.drop("_far").withColumn("_block", home(F.col("_cell"))).withColumn("_part", deal(parts)).withColumn("_share", every(shares))
        key = ["_block", "_part", "_share"]

        def pair(a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows or not b.num_rows:
                return empty
            lists = a.column("_cells").combine_chunks()
            row, cell, of_row = np.repeat(np.arange(a.num_rows), pc.list_value_length(lists).to_numpy()), lists.flatten().to_numpy(), b.column("_cell").to_numpy()
            a, b, found = a.select(names[0]), b.select(names[1]), [empty]
            for c in np.unique(of_row):
                some = row[cell == c]
                if len(some):
                    # from Arrow to Arrow: one column each, whatever came as chunks
                    out = fn(a.take(pa.array(some)).combine_chunks(), b.take(pa.array(np.flatnonzero(of_row == c))).combine_chunks())
                    found.append(pa.table(out).cast(empty.schema))
            return pa.concat_tables(found)
        empty = self.spark.createDataFrame([], schema).toArrow()
        left, right = (x.repartition(tasks, *key) for x in (left, right))
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(pair, schema)
