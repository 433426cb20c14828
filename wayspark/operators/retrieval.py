"""Trajectory retrieval: cosine and Hausdorff ranks, coverage of the best matches."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import BLOCK_BYTES, best_rows, matrix
from ..functions.draws import draw_int
from ..functions.geo import to_xy
from ..functions.pivots import PivotIndex, angle, largest_difference
from ..session import cut_lineage
from .scores import melt

DECIMALS = 9
ROUNDING = 1e-4         # rad: similarities equal after rounding differ by less


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _doubles(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(key, F.col(vector).cast("array<double>").alias("v"))


def _field(df: DataFrame, key: str) -> str:
    return f"{key} {df.schema[key].dataType.simpleString()}"


def _row_bytes(df: DataFrame, vector: str) -> int:
    """Bytes of a row with its vector; all vectors have the length of the first."""
    first = df.select(F.size(vector)).first()
    return 8 * max(first[0] if first else 1, 1)


def _parts(rows: np.ndarray, against: int):
    """Slices of ``rows`` whose comparison with ``against`` rows stays small."""
    step = max(1, 4_000_000 // max(against, 1))
    return (rows[lo:lo + step] for lo in range(0, len(rows), step))


def cosine_ranks(queries: DataFrame, database: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """Rank of each query's own database row by cosine similarity, ties against the query.

    (key, rank): number of rows at least as similar as the true one, itself included. Similarities
    are compared after rounding, so that equal vectors tie on every machine. Keys are unique. Cones around pivots (centre and
    widest angle) that lie nearer than the true row are counted whole, farther ones skipped, and the rest compared.
    """
    width = _row_bytes(database, vector)
    index = PivotIndex(_doubles(database, key, vector).select("v"), "v", angle, width, slack=ROUNDING, least_bytes=BLOCK_BYTES)
    own = _doubles(queries, key, vector).join(_doubles(database, key, vector).withColumnRenamed("v", "own"), key)

    def true_angle(batches):
        for batch in batches:
            a, b = (_unit(matrix(batch.column(c), batch.num_rows)) for c in (1, 2))
            true = (a * b).sum(1)
            added = [pa.array(np.round(true, DECIMALS)), pa.array(np.arccos(np.clip(true, -1.0, 1.0)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *added], names=[key, "v", "true", "u"])
    asked = own.mapInArrow(true_angle, f"{_field(queries, key)}, v array<double>, true double, u double")

    def at_least(some, rows):
        a, true = _unit(matrix(some.column("v"), some.num_rows)), some.column("true").to_numpy()
        b, n = _unit(matrix(rows.column("v"), rows.num_rows)), np.zeros(len(a), np.int64)
        for part in _parts(b, len(a)):
            n += (np.round(a @ part.T, DECIMALS) >= true[:, None]).sum(1)
        return {key: some.column(key), "n": n}

    around = cut_lineage(index.around(asked, "u", whole=True).drop("u"))
    counts = index.compare(around, at_least, f"{_field(queries, key)}, n bigint", width + 16)
    return counts.unionByName(around.select(key, F.col("_sure").alias("n"))).groupBy(key).agg(F.sum("n").alias("rank"))


def cosine_top(queries: DataFrame, database: DataFrame, key: str, vector: str = "vector", k: int = 5) -> DataFrame:
    """The ``k`` most similar database rows of each query: (key, place, match), ties by name; keys are unique."""
    def nearest(asked, rows):
        rows = rows.sort_by(key)                                    # a stable sort by similarity then leaves ties by name
        a, b = (_unit(matrix(t.column("v"), t.num_rows)) for t in (asked, rows))
        best, at = np.zeros((len(a), 0)), np.zeros((len(a), 0), np.int64)
        first = 0
        for part in _parts(b, len(a)):
            best = np.concatenate([best, -np.round(a @ part.T, DECIMALS)], axis=1)
            at = np.concatenate([at, np.broadcast_to(np.arange(first, first + len(part)), (len(a), len(part)))], axis=1)
            keep = np.argsort(best, axis=1, kind="stable")[:, :k]
            best, at = np.take_along_axis(best, keep, 1), np.take_along_axis(at, keep, 1)
            first += len(part)
        take = lambda t, rows_of: t.column(key).combine_chunks().take(pa.array(rows_of))
        return {key: take(asked, np.repeat(np.arange(len(a)), at.shape[1])), "down": best.ravel() + 0.0, "match": take(rows, at.ravel())}

    width = _row_bytes(database, vector)
    index = PivotIndex(_doubles(database, key, vector), "v", angle, width, slack=ROUNDING)
    schema = f"{_field(queries, key)}, down double, match {database.schema[key].dataType.simpleString()}"
    best = lambda rows: best_rows(rows, key, ["down", "match"], k, "place")
    home = cut_lineage(index.home(_doubles(queries, key, vector), k))
    first = cut_lineage(best(index.compare(home, nearest, schema, width)).drop("place"))
    bound = first.groupBy(key).agg(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.max("down")))).alias("u"))
    rest = cut_lineage(index.around(home.withColumnRenamed("_cells", "_home").join(bound, key), "u", skip="_home").drop("_home", "u"))
    found = best(first.unionByName(index.compare(rest, nearest, schema, width)))
    return found.select(key, F.col("place").cast("bigint"), "match")


def random_ranks(queries: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """Uniform ranks in 1..n, fixed by seed."""
    return queries.select(key, (1 + F.pmod(draw_int(seed, "rank", F.col(key)), F.lit(n))).alias("rank"))


def rank_metrics(ranks: DataFrame, key: str, ks=(1, 5, 10)) -> DataFrame:
    out = {"mean_rank": F.col("rank"), "mrr": 1.0 / F.col("rank")}
    out.update({f"hr@{k}": F.when(F.col("rank") <= k, 1.0).otherwise(0.0) for k in ks})
    return melt(ranks, [key], out)


# ------------------------------------------------------------------ Hausdorff
def _xy_arrays(points: DataFrame, key: str, lat0: float, lon0: float) -> DataFrame:
    x, y = to_xy(F.col("lat"), F.col("lon"), lat0, lon0)
    pts = F.sort_array(F.collect_list(F.struct("pos", x.alias("x"), y.alias("y"))))
    return points.groupBy(key).agg(pts.alias("p")).select(key, F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def _points(table, x: str, y: str) -> np.ndarray:
    """Windows of equal length as complex numbers, (rows, points)."""
    return matrix(table.column(x), table.num_rows) + 1j * matrix(table.column(y), table.num_rows)


def _set_distance(one: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """The largest way from a point of either set to the nearest point of the other, for each of ``windows``."""
    gaps = np.abs(windows[:, :, None] - one)
    to_one, from_one = gaps.min(axis=2), gaps.min(axis=1)
    return np.concatenate([to_one, from_one], axis=1).max(axis=1)


def hausdorff_ranks(queries: DataFrame, database: DataFrame, lat0: float, lon0: float, key: str = "window_id") -> DataFrame:
    """Rank of each query's own database window by symmetric Hausdorff distance, ties against it.

    Sets whose reach to one side differs by more than the true distance are farther apart than it. So windows are looked up by
    their four reaches (``functions/pivots.py``), and the exact distance is computed for those within the true distance on all sides
    only. Points in long form; the database windows have equal lengths, keys are unique.
    """
    q, db = _xy_arrays(queries, key, lat0, lon0), _xy_arrays(database, key, lat0, lon0)
    reach = F.array(F.array_min("x"), F.array_max("x"), F.array_min("y"), F.array_max("y")).alias("reach")
    width = 2 * _row_bytes(db, "x")
    index = PivotIndex(db.select("x", "y", reach), "reach", largest_difference, width)
    own = q.select("*", reach).join(db.withColumnsRenamed({"x": "ox", "y": "oy"}), key)

    def true_distance(batches):
        for batch in batches:
            rows = [[np.asarray(v, float) for v in batch.column(c).to_pylist()] for c in ("x", "y", "ox", "oy")]
            u = [np.round(_set_distance(x + 1j * y, (ox + 1j * oy)[None])[0], 6) for x, y, ox, oy in zip(*rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(u, pa.float64())], names=[*batch.schema.names, "u"])
    arrays = "x array<double>, y array<double>, reach array<double>"
    asked = own.select(key, "x", "y", "reach", "ox", "oy").mapInArrow(true_distance, f"{_field(queries, key)}, {arrays}, ox array<double>, oy array<double>, u double").drop("ox", "oy")

    def at_least(some, rows):
        windows, n = _points(rows, "x", "y"), np.zeros(some.num_rows, np.int64)
        reaches, mine, true = (matrix(rows.column("reach"), rows.num_rows), matrix(some.column("reach"), some.num_rows), some.column("u").to_numpy())
        sets = list(zip(*([np.asarray(v, float) for v in some.column(c).to_pylist()] for c in "xy")))
        for i, (x, y) in enumerate(sets):
            near = np.flatnonzero((np.abs(reaches - mine[i]) <= true[i] + 1e-6).all(axis=1))
            for lo in range(0, len(near), 1024):
                n[i] += int((np.round(_set_distance(x + 1j * y, windows[near[lo:lo + 1024]]), 6) <= true[i]).sum())
        return {key: some.column(key), "n": n}

    around = cut_lineage(index.around(asked, "u"))
    return index.compare(around, at_least, f"{_field(queries, key)}, n bigint", width).groupBy(key).agg(F.sum("n").alias("rank"))


# ------------------------------------------------------------------ conditions
def coverage(top: DataFrame, elements: DataFrame, key: str, ks=(1, 5)) -> DataFrame:
    """cr@k: share of the query's elements (regions or roads) found in the union of its top k.
    ``elements``: distinct (key, element); queries without elements are no queries."""
    want = elements.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    found = top.join(elements.withColumnRenamed(key, "match"), "match") \
        .groupBy(key, "element").agg(F.min("place").alias("place"))
    hits = elements.join(found, [key, "element"], "left").groupBy(key).agg(
        *[F.count(F.when(F.col("place") < k, 1)).alias(f"h{k}") for k in ks])
    rows = want.join(hits, key).join(top.select(key).distinct(), key, "left_semi")
    return melt(rows, [key], {f"cr@{k}": F.col(f"h{k}") / F.col("n") for k in ks})
