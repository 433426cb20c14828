"""Embedding whitening by FEAST contour integration.

1. An entry c becomes the whole number x = floor(64 c) + 1000000; a vector is kept as packed differences from 1000000 (two bytes an
   entry where they fit). The fit list is each distinct vector once.
2. Count, sums per dimension and the products of entries, centred by the nearest whole mean, are summed exactly (integers in
   the tasks, decimals in the shuffle). The covariance is their quotient, rounded once.
3. Only matrices of dimension x dimension pass the driver. There the covariance is brought to tridiagonal form; the
   signs of the pivots of T - s (its inertia) count the eigenvalues above s, and cut the upper spectrum into
   intervals at gaps.
4. Each interval is a row of a small job: quadrature of the shifted complex solves over a circle projects a random block
   onto the interval's eigenvectors, Rayleigh-Ritz extracts them, and this is repeated until the residuals stop falling.
   An interval that ends with another number of eigenvalues than the inertia counted is an error.
5. Every vector is projected in one pass. A further pass over the fit list measures the covariance of the result.

Cases: vectors that are null, or hold null or non-finite entries, are dropped, as are empty ones; where vectors differ in length, those of the
most frequent length (the smaller of two) are taken and the others dropped; directions with an eigenvalue of at most ``LEAST`` times the largest
have no component, so equal vectors alone, or one vector, give no rows; equal eigenvalues get some orthonormal basis, the same for all
rows; entries beyond +-2^62 after scaling count as that; a deviation beyond 64 bits is null; null and repeated ids are rows of their
own; an empty table gives no rows; extra columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import drop, keep

SHIFT = 1_000_000
SCALE = 64
FAR = float(1 << 62)
EXACT = 1 << 53             # whole numbers that a double holds
LEAST = 1e-10
MOST_DIMENSIONS = 4096      # the covariance is broadcast: 128 MB at most
INTERVAL = 8                # eigenvalues in an interval, more where they lie together
NODES = 16                  # quadrature points on half a circle

PACKED = pa.schema([("vec_id", pa.int64()), ("size", pa.int32()), ("packed", pa.binary())])
SUMS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("total", pa.decimal128(38, 0)), ("n", pa.int64())])


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """floor(64 c) of the entries of every whole vector as little-endian numbers of 2, 4 or 8 bytes; the shortest that fits all."""
    for batch in batches:
        ids, vectors = batch.column(0), batch.column(1)
        sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        flat = vectors.flatten()
        entries = pc.cast(flat, pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        begins = np.append(0, np.cumsum(sizes))[:-1]
        for size in np.unique(sizes[sizes > 0]):
            rows = np.flatnonzero(sizes == size)
            values = entries[begins[rows][:, None] + np.arange(size)]
            whole = np.isfinite(values).all(axis=1)
            rows, values = rows[whole], np.clip(np.floor(SCALE * values[whole]), -FAR, FAR)
            most = np.maximum(values.max(axis=1, initial=0), -values.min(axis=1, initial=0))
            width = np.where(most < 1 << 15, 2, np.where(most < 1 << 31, 4, 8))
            for w in np.unique(width):
                own = np.flatnonzero(width == w)
                data = np.ascontiguousarray(values[own].astype(f"<i{w}"))
                step = int(size * w)
                packed = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer((np.arange(len(own) + 1) * step).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[own])), pa.array(np.full(len(own), size, np.int32)), packed], schema=PACKED)


def unpacked(column: pa.Array, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, whole numbers) of packed vectors, by width."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        data = b"".join(column.take(pa.array(rows)).to_pylist())
        yield rows, np.frombuffer(data, f"<i{size // dims}").reshape(len(rows), dims).astype(np.int64)


def totals(dims: int):
    """Counts and sums per dimension, one row a dimension and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = [0] * dims, 0
        for batch in batches:
            for _, z in unpacked(batch.column(0), dims):
                n += len(z)
                high = np.abs(z).max(initial=0)
                part = z.sum(axis=0) if int(high) * len(z) < 1 << 62 else z.astype(object).sum(axis=0)
                sums = [a + int(b) for a, b in zip(sums, part)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([0] * dims, pa.int32()), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0)), pa.array([n] * dims)], schema=SUMS)
    return run


def products(dims: int, middle: list[int]):
    """Sums of products of the entries less ``middle``, one row for each two dimensions and task."""
    i, j = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n, centre = np.zeros((dims, dims), object), 0, np.array(middle, np.int64)
        for batch in batches:
            for _, z in unpacked(batch.column(0), dims):
                n += len(z)
                y = z - centre
                high = int(np.abs(y).max(initial=0))
                if high * high * len(y) < EXACT:
                    part = (y.T.astype(float) @ y.astype(float)).astype(np.int64)
                elif high * high * len(y) < 1 << 62:
                    part = y.T @ y
                else:
                    part = y.T.astype(object) @ y.astype(object)
                sums = sums + part
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(int(s)) for s in sums[i, j]], pa.decimal128(38, 0)),
                                              pa.array(np.full(len(i), n))], schema=SUMS)
    return run


def summed(rows: DataFrame) -> list:
    return rows.groupBy("i", "j").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of the similar tridiagonal matrix (reflections)."""
    a = matrix.copy()
    d = len(a)
    off = np.zeros(max(0, d - 1))
    for k in range(d - 2):
        x = a[k + 1:, k].copy()
        length = np.linalg.norm(x)
        off[k] = -np.copysign(length, x[0])
        x[0] -= off[k]
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        v = x / norm
        p = a[k + 1:, k + 1:] @ v
        w = 2 * (p - (v @ p) * v)
        a[k + 1:, k + 1:] -= np.outer(v, w) + np.outer(w, v)
    if d > 1:
        off[-1] = a[-1, -2]
    return np.diag(a).copy(), off


def above(form: tuple[np.ndarray, np.ndarray], shifts: np.ndarray) -> np.ndarray:
    """Inertia: how many eigenvalues exceed each shift, from the signs of the pivots."""
    diagonal, off = form
    tiny = np.finfo(float).tiny ** 0.5
    pivot = diagonal[0] - shifts
    count = (pivot > 0).astype(int)
    for t, b in zip(diagonal[1:], off):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = t - shifts - b * b / pivot
        count += pivot > 0
    return count


def intervals(form: tuple[np.ndarray, np.ndarray], components: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) from the top down, with at least ``components`` eigenvalues above ``LEAST`` of the
    largest, if there are as many. Cuts lie in gaps; eigenvalues that bisection cannot tell apart stay together."""
    diagonal, off = form
    reach = np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    low, high = float((diagonal - reach).min()), float((diagonal + reach).max())
    scale = max(abs(low), abs(high))
    if scale == 0:
        return []
    want = np.arange(1, min(len(diagonal), components + INTERVAL) + 1)
    lows, highs = np.full(len(want), low - 0.1 * scale), np.full(len(want), high + 0.1 * scale)
    for _ in range(60):                                       # the largest shift with at least so many eigenvalues above it
        middle = (lows + highs) / 2
        enough = above(form, middle) >= want
        lows, highs = np.where(enough, middle, lows), np.where(enough, highs, middle)
    values = lows
    last = int(np.sum(values > LEAST * values[0]))
    components = min(components, last)
    same, out, done = 1e-9 * scale, [], 0
    while done < components:
        # end behind one of the next eigenvalues, where the gap is widest
        below = np.append(values, low - scale)[done + 1:]
        gaps = (values[done:] - below)[:INTERVAL]
        end = done + int(np.argmax(gaps)) + 1
        while end < len(values) and values[end - 1] - values[end] <= same:
            end += 1
        gap = values[end - 1] - (values[end] if end < len(values) else low - scale)
        if end == len(values) and end < len(diagonal):        # all listed ones lie together: go on below them, to the next gap
            cut = values[end - 1] - same
            while above(form, np.array([cut - same]))[0] > above(form, np.array([cut + same / 2]))[0]:
                cut -= same
            gap = 2 * (values[end - 1] - cut)
        # the circle is hardly wider than its eigenvalues, so that those beyond a small gap are damped as well
        width = max(values[done] - values[end - 1], 1e-7 * scale)
        under = values[end - 1] - min(gap / 2, width)
        over = values[done] + (width if done == 0 else min((values[done - 1] - values[done]) / 2, width))
        more, all_ = above(form, np.array([over, under]))
        out.append((float(under), float(over), int(all_ - more)))
        done = int(all_)
    return out


def feast(matrix: np.ndarray, low: float, high: float, count: int, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues of the interval, falling, and their vectors as columns."""
    d = len(matrix)
    centre, radius = (low + high) / 2, (high - low) / 2
    points = radius * np.exp(1j * np.pi * (np.arange(NODES) + 0.5) / NODES)
    block = np.random.default_rng(12).standard_normal((d, min(d, count + max(6, count // 2))))
    scale, best, found = np.abs(matrix).sum(axis=1).max(), np.inf, None
    for _ in range(rounds):
        # conjugate points give conjugate solves, so half the circle and the real part suffice
        projected = sum((z * np.linalg.solve((centre + z) * np.eye(d) - matrix, block)).real for z in points) / NODES
        basis, strength, _ = np.linalg.svd(projected, full_matrices=False)
        basis = basis[:, :max(count, int(np.sum(strength > 1e-6 * strength[0])))]       # what the filter left only as rounding is no direction
        small = basis.T @ (matrix @ basis)
        values, turns = np.linalg.eigh((small + small.T) / 2)               # Rayleigh-Ritz
        block = basis @ turns
        inside = np.flatnonzero((values > low) & (values < high))
        errors = np.linalg.norm(matrix @ block[:, inside] - block[:, inside] * values[inside], axis=0) / scale
        real = errors < max(1e-12, 1e-3 * radius / scale)                   # others are no eigenvalues of the matrix
        inside = inside[real]
        if len(inside) == count:
            error = errors[real].max(initial=0)
            if error >= best / 2 and best < 1e-12:
                break
            if error < best:
                best, found = error, (values[inside][::-1], block[:, inside[::-1]])
    if found is None or best > 1e-10:
        raise ArithmeticError(f"the interval ({low}, {high}) holds {count} eigenvalues, found {len(inside)} with residual {best}")
    vectors = found[1] / np.linalg.norm(found[1], axis=0)
    return found[0], vectors


def components(spark, covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues, falling, and unit vectors: one task an interval."""
    cuts = intervals(tridiagonal(covariance), most)
    d = len(covariance)
    if not cuts:
        return np.zeros(0), np.zeros((d, 0))
    matrix = spark.sparkContext.broadcast(covariance)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low, high, count in zip(frame["low"], frame["high"], frame["count"]):
                values, vectors = feast(matrix.value, low, high, count)
                yield pd.DataFrame({"value": values, "vector": list(vectors.T)})

    jobs = spark.createDataFrame(cuts, "low double, high double, count int").repartition(len(cuts))
    pairs = sorted(jobs.mapInPandas(solve, "value double, vector array<double>").collect(), key=lambda r: -r["value"])[:most]
    values, vectors = np.array([r["value"] for r in pairs]), np.array([r["vector"] for r in pairs]).T
    real = values > LEAST * values[0]
    return values[real], vectors[:, real]


class Whitener:
    """The fit: n, sums per dimension, components and how far the whitened fit list is from the identity."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums, self.values, self.vectors, self.trace, self.error = n, sums, values, vectors, trace, 0.0

    def offsets(self, z: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        high = max(int(np.abs(z).max(initial=0)) * self.n, max(map(abs, self.sums), default=0))
        if high < 1 << 61:
            return z * self.n - np.array(self.sums, np.int64)
        return z.astype(object) * self.n - np.array(self.sums, object)

    def project(self, offsets: np.ndarray) -> np.ndarray:
        return (offsets / self.n).astype(float) @ self.vectors / np.sqrt(self.values)


def deviations(offsets: np.ndarray) -> pa.Array:
    """Sums of squares, exactly; null beyond 64 bits."""
    if offsets.dtype != object and float(np.abs(offsets).max(initial=0)) ** 2 * offsets.shape[1] < float(1 << 62):
        return pa.array((offsets * offsets).sum(axis=1))
    whole = (offsets.astype(object) ** 2).sum(axis=1)
    return pa.array([int(v) if v < 1 << 63 else None for v in whole], pa.int64())


def fit(rows: DataFrame, dims: int, most: int) -> Whitener | None:
    """Fits on the distinct vectors of ``rows`` (packed)."""
    if dims > MOST_DIMENSIONS:
        raise ValueError(f"{dims} dimensions; the covariance is broadcast for at most {MOST_DIMENSIONS}")
    spark = rows.sparkSession
    listed = keep(rows.select("packed").distinct(), "vectors")
    schema = "i int, j int, total decimal(38,0), n long"
    first = summed(listed.mapInArrow(totals(dims), schema))
    if not first:
        drop(listed)
        return None
    n, sums = first[0]["n"], [0] * dims
    for r in first:
        sums[r["i"]] = int(r["total"])
    middle = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, middle)]
    covariance = np.zeros((dims, dims))
    for r in summed(listed.mapInArrow(products(dims, middle), schema)):
        i, j = r["i"], r["j"]
        covariance[i, j] = covariance[j, i] = float(Fraction(n * int(r["total"]) - rest[i] * rest[j], n * n))
    model = Whitener(n, sums, *components(spark, covariance, most), float(np.trace(covariance)))
    k = len(model.values)
    if k:
        at = np.triu_indices(k)

        def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            squares, ones = np.zeros((k, k)), np.zeros(k)
            for batch in batches:
                for _, z in unpacked(batch.column(0), dims):
                    y = model.project(model.offsets(z))
                    squares += y.T @ y
                    ones += y.sum(axis=0)
            yield pa.RecordBatch.from_pydict({"i": pa.array([*at[0], *range(k)], pa.int32()), "j": pa.array([*at[1], *[-1] * k], pa.int32()), "total": pa.array([*squares[at], *ones])})

        found = {(r["i"], r["j"]): r["total"] / n for r in listed.mapInArrow(moments, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()}
        model.error = max(abs(found[i, j] - found[i, -1] * found[j, -1] - (i == j)) for i, j in zip(*at))
    drop(listed)
    return model


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, *, column: str = "embedding", most: int = 16) -> DataFrame:
    """One row for each vector and component: the whitened value, and the fit's figures."""
    spark = embeddings.sparkSession
    # the one pass over the vectors: all later ones read a quarter of the bytes or less
    packed = keep(embeddings.select("vec_id", F.col(column).alias("vector")).mapInArrow(pack, "vec_id long, size int, packed binary"), "packed")
    lengths = packed.groupBy("size").count().orderBy(F.desc("count"), "size").limit(1).collect()
    dims = lengths[0]["size"] if lengths else 0
    rows = packed.filter(F.col("size") == dims).select("vec_id", "packed")
    model = fit(rows, dims, most) if dims else None
    if model is None or not len(model.values):
        return spark.createDataFrame([], OUT)
    model = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        k = len(own.values)
        share = own.values / own.trace
        for batch in batches:
            for at, z in unpacked(batch.column(1), dims):
                offsets = own.offsets(z)
                m = len(at)
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_pydict({
                    "vec_id": batch.column(0).take(pa.array(np.repeat(at, k))), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), "n": pa.array(np.full(m * k, own.n)),
                    "deviation": deviations(offsets).take(each), "whitened": pa.array(own.project(offsets).ravel()), "explained": pa.array(np.tile(share, m)),
                    "identity_error": pa.array(np.full(m * k, own.error))})

    return rows.mapInArrow(run, OUT)
