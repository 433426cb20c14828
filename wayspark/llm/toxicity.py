"""Toxicity scores by follow-the-regularised-leader (FTRL-proximal) logistic regression.

Features are the presence of hashed lower-case words, word pairs and one-word skip pairs. Only features that occur in at
least ``least_rows`` training rows take part, and L1 keeps few of their weights, so the model is compact; the hash space bounds
what is broadcast: at most 4 bytes x 2^``bits``, whatever the corpus.

Training rows: at most about ``max_rows`` labelled rows, drawn by a hash of the id (the documented bound of the fit). Their
features are made in parallel; the updates, which depend on each other, run over that bounded sample in the order of the
hash, in one task (``shards`` > 1: in several, whose weights are averaged). Every row is scored.

Cases: a null text is an empty one and gets the bias alone; null labels and labels without a document are not learned
from; several labels of one id count as toxic if one does; with no labelled rows every score is 0.5 and no weight is set.
"""
from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T

PAIR, SKIP = 0xA24BAED4963EE407, 0x9FB21C651E98DF25


def held_out(key: str | Column, parts: int, rest: int) -> Column:
    column = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % parts == rest


def features(data: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every word, pair and skip pair of a run of texts."""
    data = T.LOWER[data]
    starts, ends, first = T.words(data, at, T.BREAKS)
    code, row = T.word_codes(data, starts, ends), T.owner(first)
    slots, rows = [code], [row]
    for gap, factor in ((1, PAIR), (2, SKIP)):
        if len(code) > gap:
            same = row[:-gap] == row[gap:]
            slots.append(T.mix(code[:-gap] * np.uint64(factor) + code[gap:])[same])
            rows.append(row[:-gap][same])
    return np.concatenate(rows), (np.concatenate(slots) >> np.uint64(64 - bits)).astype(np.int64)


class Leader:
    """FTRL-proximal state: z, n and the weights they imply, coordinate by coordinate."""

    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        error = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += error - (np.sqrt(n + error * error) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + error * error


ROW = pa.schema([("shard", pa.int32()), ("draw", pa.int64()), ("label", pa.float64()), ("slots", pa.binary())])
WEIGHT = pa.schema([("slot", pa.int64()), ("weight", pa.float64())])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", *, bits: int = 20, max_rows: int = 24_000,
        least_rows: int = 3, shards: int = 1, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 2.0, l2: float = 0.0) -> DataFrame:
    """(slot, weight) of the non-zero averaged weights; slot 2^bits is the bias."""
    marks = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("double").alias("_label"))
    own = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    draw = F.xxhash64("_key", F.lit("ftrl"))
    total = own.select("_key").join(marks, "_key").count()
    if total > max_rows:
        marks = marks.filter(F.shiftrightunsigned(draw, 11) < F.lit(int((1 << 53) * max_rows / total)))
    rows = own.join(marks, "_key").select(F.pmod(draw, F.lit(shards)).cast("int").alias("shard"), draw.alias("draw"), F.col("_label").alias("label"), "_text")
    bias = 1 << bits

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in T.runs(batch.column(3)):
                row, slot = features(data, at, bits)
                pairs = np.unique(row << (bits + 1) | slot)
                edges = np.searchsorted(pairs >> (bits + 1), np.arange(hi - lo + 1))
                found = [np.append(pairs[a:b] & (2 * bias - 1), bias).astype(np.int32).tobytes() for a, b in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[lo:hi] for c in range(3)), pa.array(found, pa.binary())], schema=ROW)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, part in itertools.groupby((row for b in batches for row in b.to_pylist()), key=lambda r: r["shard"]):
            seen = [(r["label"], np.frombuffer(r["slots"], np.int32)) for r in part]
            often = np.zeros(bias + 1, np.int32)
            for _, at in seen:
                often[at] += 1
            seen = [(mark, at[often[at] >= least_rows]) for mark, at in seen]
            model = Leader(bits, alpha, beta, l1, l2)
            for _ in range(epochs):
                for mark, at in seen:
                    model.learn(at, mark)
            weight = model.weights(slice(None))
            found = np.flatnonzero(weight)
            yield T.batch_of(WEIGHT, found, weight[found] / shards)

    made = rows.mapInArrow(slots, "shard int, draw long, label double, slots binary")
    parts = made.repartition(shards, "shard").sortWithinPartitions("shard", "draw").mapInArrow(learn, "slot long, weight double")
    return parts.groupBy("slot").agg(F.sum("weight").alias("weight"))


def collect(weights: DataFrame, bits: int = 20) -> tuple[np.ndarray, float]:
    """Dense weights and the bias on the driver, bounded by the hash space."""
    table = weights.toArrow()
    dense = np.zeros((1 << bits) + 1, np.float32)
    dense[table.column("slot").to_numpy()] = table.column("weight").to_numpy()
    return dense[:-1], float(dense[-1])


def score(docs: DataFrame, model: tuple[np.ndarray, float], key: str = "doc_id", text: str = "text", bits: int = 20) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) appended, one pass without a shuffle. A column ``score`` in ``docs`` is an error, raised at once."""
    if "score" in docs.columns:
        raise ValueError("the input already has ['score']")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "score double"
    names = docs.columns
    place = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, bias = shared.value
        for batch in batches:
            scores = np.full(batch.num_rows, 0.0)
            for lo, hi, data, at in T.runs(batch.column(place)):
                row, slot = features(data, at, bits)
                hit = np.flatnonzero(dense[slot])
                pairs = np.unique(row[hit] * (1 << bits) + slot[hit])
                scores[lo:hi] = bias + np.bincount(pairs >> bits, dense[pairs & ((1 << bits) - 1)], hi - lo)
            scores = 1.0 / (1.0 + np.exp(-np.clip(scores, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, {schema}")


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **options) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Learns only from rows that are not held out."""
    seen = docs.filter(~held_out("doc_id", 4, 2))
    model = collect(fit(seen, labels, **options))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **options) -> DataFrame:
    """The documents whose score stays below ``threshold``, columns unchanged."""
    model = collect(fit(docs.filter(~held_out("doc_id", 4, 2)), labels, **options))
    own = docs.withColumnsRenamed({c: f"_kept_{n}" for n, c in enumerate(docs.columns)})
    at = docs.columns.index("text")
    scored = score(own, model, text=f"_kept_{at}").filter(F.col("score") < threshold)
    return scored.select(*(F.col(f"_kept_{n}").alias(c) for n, c in enumerate(docs.columns)))
