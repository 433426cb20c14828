"""Poisson bootstrap with weight vectors: a sample's weights in all replicates are drawn where the sample lies and added up
there, so what is shuffled is one vector a group and task, whatever the number of replicates."""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import CHUNK, range_chunks

ROWS = 2048             # samples whose weights are in memory at a time
GROUPS = 4096           # groups whose sums a task holds before it hands them on
# Increment and multipliers of the published SplitMix64 generator.
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

_TERMS = [math.exp(-1.0) / math.factorial(k) for k in range(11)]
POISSON_1 = np.cumsum(_TERMS)


def weights(ids: list, n_boot: int, seed: int) -> np.ndarray:
    """Poisson(1) counts (ids, n_boot): the stream of SplitMix64 that starts at a hash of (seed, id)."""
    start = np.array([int(hashlib.md5(f"{seed}|boot|{i}".encode()).hexdigest()[:16], 16) for i in ids], np.uint64)
    z = start[:, None] + np.arange(1, n_boot + 1, dtype=np.uint64) * np.uint64(STEP)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(FIRST)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(SECOND)
    z ^= z >> np.uint64(31)
    u = (z >> np.uint64(11)).astype(float) / float(1 << 53)
    return np.searchsorted(POISSON_1, u.ravel(), "right").reshape(u.shape).astype(float)


def _coded(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each group, group of every row) of rows that agree in all columns."""
    code = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        part = column.dictionary_encode(null_encoding="encode")
        code = np.unique(code * max(1, len(part.dictionary)) + part.indices.to_numpy(), return_inverse=True)[1]
    _, first, group = np.unique(code, return_index=True, return_inverse=True)
    return first, group


class _Sums:
    """Vectors by group; the values of the group's columns are kept as they came."""

    def __init__(self, schema: pa.Schema, keys: int):
        self.schema, self.keys, self.held = schema, keys, {}

    def add(self, key: tuple, *vectors: np.ndarray) -> None:
        own = self.held.get(key)
        if own is None:
            self.held[key] = [v.copy() for v in vectors]
        else:
            for a, b in zip(own, vectors):
                a += b

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.held), self.schema)]
            for n in range(len(self.schema) - self.keys):
                flat = np.concatenate([v[n] for v in self.held.values()])
                size = len(flat) // len(self.held)
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(self.held) + 1) * size, pa.int32()), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)
        self.held = {}


def _schema(df: DataFrame, keys: list[str], names: list[str]) -> pa.Schema:
    own = df.select(*keys).limit(0).toArrow().schema
    return pa.schema([own.field(k) for k in keys] + [pa.field(n, pa.list_(pa.float64())) for n in names])


def _ddl(df: DataFrame, keys: list[str], rest: str) -> str:
    return ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in keys] + [rest])


def weighted_sums(samples: DataFrame, keys: list[str], n_boot: int, seed: int) -> DataFrame:
    """(keys, w, wv): sums of the weights and of weight times ``value`` in every replicate, from (keys, sample_id, value)."""
    schema = _schema(samples, keys, ["w", "wv"])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(schema, len(keys))
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                ids = batch.column(len(keys)).dictionary_encode(null_encoding="encode")
                drawn = weights(ids.dictionary.to_pylist(), n_boot, seed)
                at, value = ids.indices.to_numpy(), batch.column(len(keys) + 1).to_numpy()
                first, group = _coded([batch.column(n) for n in range(len(keys))])
                for g, key in enumerate(zip(*(batch.column(n).take(pa.array(first)).to_pylist() for n in range(len(keys))))):
                    rows = np.flatnonzero(group == g)
                    own = drawn[at[rows]]
                    sums.add(key, own.sum(0), value[rows] @ own)
                if len(sums.held) > GROUPS:
                    yield from sums.out()
        yield from sums.out()

    kind = _ddl(samples, keys, "w array<double>, wv array<double>")
    partial = samples.select(*keys, F.col("sample_id").cast("string"), F.col("value").cast("double")).mapInArrow(draw, kind)
    return _merged(partial, keys, ["w", "wv"], schema, kind)


def _merged(partial: DataFrame, keys: list[str], names: list[str], schema: pa.Schema, kind: str) -> DataFrame:
    """The vectors of equal keys added: a task holds one group at a time."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(schema, len(keys))
        for batch in batches:
            key_rows = list(zip(*(batch.column(n).to_pylist() for n in range(len(keys)))))
            vectors = [batch.column(len(keys) + n) for n in range(len(names))]
            for row, key in enumerate(key_rows):
                if sums.held and key not in sums.held:
                    yield from sums.out()
                sums.add(key, *(v[row].values.to_numpy() for v in vectors))
        yield from sums.out()
    return partial.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(add, kind)


def weighted_quantiles(samples: DataFrame, keys: list[str], q: str, n_boot: int, seed: int) -> DataFrame:
    """(keys, rep, value): the interpolated quantile ``q`` (a column, one value a group) of every resample.

    Values are cut into range chunks, ties by a hash of the sample, so that no chunk is larger than a task's share. The chunks'
    weight vectors tell in which chunk each replicate's rank lies; only those chunks are read again and sorted.
    """
    rows = samples.select(*keys, F.col(q).cast("double").alias("_q"), F.col("sample_id").cast("string").alias("sample_id"), F.col("value").cast("double").alias("value"))
    rows = range_chunks(rows.withColumn("_tie", F.xxhash64("sample_id")), [*keys, "value", "_tie"]).drop("_tie")
    groups = [*keys, "_q", CHUNK]
    totals = weighted_sums(rows, groups, n_boot, seed).select(*groups, "w")
    kinds = samples.select(*keys).limit(0).toArrow().schema

    def ranks(table: pa.Table) -> pa.Table:
        table = table.sort_by(CHUNK).combine_chunks()
        upto = np.cumsum([w.values.to_numpy() for w in table.column("w").combine_chunks()], axis=0)
        size = upto[-1]
        h = table.column("_q")[0].as_py() * (size - 1)
        found = []
        for side, rank in enumerate((np.floor(h) + 1, np.ceil(h) + 1)):
            chunk = (upto < rank).sum(axis=0)
            for n in np.unique(chunk[size > 0]):
                reps = np.flatnonzero((chunk == n) & (size > 0))
                before = upto[n - 1][reps] if n else 0.0
                found.append((int(n), np.full(len(reps), side), reps, rank[reps] - before, (h - np.floor(h))[reps]))
        at = pa.array([f[0] for f in found], pa.int64())
        lists = lambda n, kind: pa.array([f[n] for f in found], pa.list_(kind))
        return pa.table([table.column(k).take(at).combine_chunks() for k in [*keys, CHUNK]] + [lists(1, pa.int32()), lists(2, pa.int32()), lists(3, pa.float64()), lists(4, pa.float64())],
                        names=[*keys, CHUNK, "side", "rep", "rank", "part"])

    lists = f"{CHUNK} bigint, side array<int>, rep array<int>, rank array<double>, part array<double>"
    wanted = totals.groupBy(*keys).applyInArrow(ranks, _ddl(samples, keys, lists))

    def pick(own: pa.Table, asked: pa.Table) -> pa.Table:
        side, rep, rank, part = (np.concatenate([x.values.to_numpy() for x in asked.column(c).combine_chunks()]) for c in ("side", "rep", "rank", "part"))
        own = own.sort_by("value").combine_chunks()
        ids, value = own.column("sample_id").to_pylist(), own.column("value").to_numpy()
        reps, column = np.unique(rep, return_inverse=True)
        out, open_, upto = np.full(len(rep), np.nan), np.ones(len(rep), bool), np.zeros(len(reps))
        for lo in range(0, len(ids), ROWS):
            some, again = np.unique(np.array([str(i) for i in ids[lo:lo + ROWS]], object), return_inverse=True)
            sums = upto + np.cumsum(weights(list(some), n_boot, seed)[again][:, reps], axis=0)
            left = np.flatnonzero(open_ & (sums[-1][column] >= rank))
            if len(left):
                out[left] = value[lo + (sums[:, column[left]] < rank[left]).sum(axis=0)]
                open_[left] = False
            upto = sums[-1]
        n = len(rep)
        key = [pa.repeat(asked.column(k)[0], n) if asked.column(k)[0].is_valid else pa.nulls(n, kinds.field(k).type) for k in keys]
        return pa.table([*key, pa.array(side, pa.int32()), pa.array(rep, pa.int32()), pa.array(out), pa.array(part)], names=[*keys, "side", "rep", "value", "part"])

    chunk = [*keys, CHUNK]
    same = [rows[k].eqNullSafe(wanted[k]) for k in chunk]
    held = rows.join(wanted.select(*chunk).distinct(), same, "left_semi").select(*chunk, "sample_id", "value")
    found = held.groupBy(*chunk).cogroup(wanted.groupBy(*chunk)).applyInArrow(pick, _ddl(samples, keys, "side int, rep int, value double, part double"))
    lo, hi = F.max(F.when(F.col("side") == 0, F.col("value"))), F.max(F.when(F.col("side") == 1, F.col("value")))
    return found.groupBy(*keys, "rep").agg((lo + (hi - lo) * F.max("part")).alias("value"))
