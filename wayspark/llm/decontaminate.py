"""Benchmark passages in documents, found by the q-gram lemma and confirmed by banded alignment.

A passage of m characters that occurs with at most e edits keeps at least m - q + 1 - q*e of its q-grams, all
on diagonals (document position minus passage position) that differ by at most e. Shared q-grams are counted in
overlapping bands of diagonals, 2(e+1) wide and e+1 apart, so one band holds them all; bands below the bound are
passed over and the rest are aligned. The budget e is ``rate`` of the whole passage's length, whatever that is. ``q`` is the longest gram;
a passage for which the bound would be 0 takes the longest gram that keeps it at 1 or more, m / (e + 1). So nothing within
the budget is lost: short passages have an index of shorter grams of their own, and those without a budget are searched as they are.

The stated query set is the benchmark. It is broadcast in blocks of at most ``BLOCK_CHARS`` characters (one passage at
least), one block at a time: with several, what a block finds is written before the next one is sent. Documents are read once per block and never
shuffled. Alignment of a passage takes time in proportion to m * e, and memory to e.

Both sides are compared with A-Z lower-cased and ASCII white space as a space. Cases: null or empty texts match
nothing; equal passages match each under their own id; benchmark rows that agree in id and text count once, those that share only an id are
passages of their own; a null id is kept as it is; a document that holds a passage several times gives its closest place.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._scratch import keep

BLOCK_CHARS = 8_000_000
Q, RATE = 10, 0.08
FILTER_BITS = 24
OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())])


def plain(data: np.ndarray) -> np.ndarray:
    """Code points with A-Z lowered and ASCII white space as a space."""
    data = np.where((data >= 65) & (data <= 90), data + np.uint32(32), data)
    return np.where((data >= 9) & (data <= 13), np.uint32(32), data)


def grams(chars: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every q-gram: spans of doubling length, the last two overlapping where q is no power of two."""
    out, length = chars.astype(np.uint64) * np.uint64(T.BYTE_BASE), 1
    while length < q:
        step = min(length, q - length)
        if len(out) <= step:
            return np.zeros(0, np.uint64)
        out = out[:-step] * np.uint64(T.WORD_BASE) + (out[step:] ^ (out[step:] >> np.uint64(29)))
        length += step
    return out * np.uint64(T.BYTE_BASE)


def budget(length: int, rate: float) -> int:
    return int(length * rate)


def gram_length(length: int, q: int, rate: float) -> int:
    """The longest gram of at most ``q`` characters of which a passage within its budget keeps one or more."""
    return max(1, min(q, length // (budget(length, rate) + 1)))


def indexes(items: list[tuple[int, str]], q: int, rate: float) -> list[Index]:
    """The passages of a block by the length of their grams."""
    by: dict[int, list] = {}
    for item, text in items:
        chars = plain(np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32))
        if len(chars):
            by.setdefault(gram_length(len(chars), q, rate), []).append((item, chars))
    return [Index(own, length, rate) for length, own in sorted(by.items())]


class Index:
    """Q-grams of passages: a bit filter and sorted postings."""

    def __init__(self, items: list[tuple[int, np.ndarray]], q: int, rate: float):
        self.q, self.ids, self.text, self.budget, self.least = q, [], [], [], []
        keys, owners, places = [], [], []
        for item, chars in items:
            found, edits = grams(chars, q), budget(len(chars), rate)
            keys.append(found)
            owners.append(np.full(len(found), len(self.ids), np.int32))
            places.append(np.arange(len(found), dtype=np.int32))
            self.ids.append(item)
            self.text.append(chars)
            self.budget.append(edits)
            self.least.append(len(chars) - q + 1 - q * edits)
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[order]
        self.owner = (np.concatenate(owners) if keys else np.zeros(0, np.int32))[order]
        self.place = (np.concatenate(places) if keys else np.zeros(0, np.int32))[order]
        self.budget, self.least = np.array(self.budget, np.int64), np.array(self.least, np.int64)
        self.filter = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        at = self.keys >> np.uint64(64 - FILTER_BITS)
        np.bitwise_or.at(self.filter, (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))

    def hits(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, piece, position in the piece) of shared q-grams."""
        keys = grams(chars, self.q)
        at = keys >> np.uint64(64 - FILTER_BITS)
        maybe = np.flatnonzero((self.filter[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
        keys = keys[maybe]
        lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        n = hi - lo
        take = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(maybe, n), self.owner[take], self.place[take]


def align(passage: np.ndarray, region: np.ndarray, limit: int) -> tuple[int, int, int]:
    """(edits, start, end) of the best place of ``passage`` in ``region``; both of its ends are free. Rows are the
    passage's characters; cells outside the band around the region's free diagonals cannot stay within the limit."""
    m, n = len(passage), len(region)
    band = n - m + limit + 1                            # diagonals -limit .. n - m + limit
    if band <= 0:
        return limit + 1, 0, 0
    far = m + n + 1
    offset = np.arange(-limit, n - m + limit + 1)
    cost = np.where((offset >= 0) & (offset <= n), 0, far).astype(np.int64)
    origin = offset.copy()
    run = np.arange(len(offset))
    for i in range(1, m + 1):
        j = offset + i
        inside = (j >= 1) & (j <= n)
        differs = np.ones(len(offset), np.int64)
        differs[inside] = region[j[inside] - 1] != passage[i - 1]
        best, start = np.where(inside, cost + differs, far), origin.copy()
        up = np.append(cost[1:], far) + 1               # a passage character left out
        better = up < best
        best = np.where(better, up, best)
        start = np.where(better, np.append(origin[1:], 0), start)
        best = np.where((j >= 0) & (j <= n), best, far)
        low = np.minimum.accumulate(best - run)         # region characters put in
        step = np.where(best - run == low, run, 0)
        step = np.maximum.accumulate(step)
        cost, origin = np.minimum(low + run, far), start[step]
    end = int(np.argmin(cost))
    return int(cost[end]), int(origin[end]), int(offset[end] + m)


def matches(index: Index, chars: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, end, edits) of every confirmed region of one text."""
    place, piece, inner = index.hits(chars)
    enough = np.bincount(piece, minlength=len(index.least)) >= index.least     # in all bands together
    held = enough[piece]
    if not held.any():
        return
    piece, inner, diagonal = piece[held], inner[held], (place - inner)[held]
    step, seen, exact = index.budget[piece] + 1, set(), {}
    for shift in (0, 1):
        cell = (diagonal + shift * step) // (2 * step)
        order = np.lexsort((inner, cell, piece))
        p, c, at, far = piece[order], cell[order], inner[order], diagonal[order]
        new = np.append(True, (p[1:] != p[:-1]) | (c[1:] != c[:-1]))
        first = np.flatnonzero(new)
        stop = dict(zip(first, np.append(first[1:], len(p))))
        shared = np.add.reduceat((new | np.append(True, at[1:] != at[:-1])).astype(np.int64), first)
        for k in first[shared >= index.least[p[first]]]:
            passage, edits = index.text[p[k]], int(index.budget[p[k]])
            low = (2 * int(c[k]) - shift) * (edits + 1)
            lo, hi = max(0, low - edits), min(len(chars), low + 2 * (edits + 1) + len(passage) + edits)
            if any(lo <= d and d + len(passage) <= hi for d in exact.get(int(p[k]), ())):
                continue                                # nothing in this region can be closer
            main = int(np.bincount(far[k:stop[k]] - far[k:stop[k]].min()).argmax() + far[k:stop[k]].min())
            if main >= 0 and np.array_equal(chars[main:main + len(passage)], passage):
                exact.setdefault(int(p[k]), []).append(main)
                cost, start, end = 0, main - lo, main - lo + len(passage)
            else:
                cost, start, end = align(passage, chars[lo:hi], edits)
            found = (int(p[k]), lo + start, lo + end, cost)
            if cost <= edits and found not in seen:
                seen.add(found)
                yield found


def list_blocks(benchmark: DataFrame, limit: int = BLOCK_CHARS) -> list[Callable[[], list[tuple[int, str]]]]:
    """The query set in blocks of about ``limit`` characters, cut by a hash of the row; a block is fetched when it is called."""
    rows = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    size = rows.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    parts = max(1, -(-int(size) // limit))

    def block(part: int) -> list[tuple[int, str]]:
        own = rows if parts == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        return [(r[0], r[1]) for r in own.sort("item_id", "text").collect()]
    return [lambda part=part: block(part) for part in range(parts)]


def closest(block: list[Index], text: str | None) -> Iterator[tuple[int, int, int, int]]:
    """(item, start, end, edits) of every passage of a block that a text holds."""
    if not text:
        return
    chars = plain(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32))
    for index in block:
        best: dict[int, tuple] = {}
        for p, start, end, edits in matches(index, chars):
            new = (edits, start, end)
            if p not in best or new < best[p]:
                best[p] = new
        yield from ((index.ids[p], start, end, edits) for p, (edits, start, end) in best.items())


def leaks(docs: DataFrame, benchmark: DataFrame, *, q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, start, end, edits): for every document and passage that it holds, the closest place, in characters."""
    spark, out = docs.sparkSession, None
    blocks_ = list_blocks(benchmark, block_chars)
    for n, items in enumerate(blocks_):
        shared = spark.sparkContext.broadcast(indexes(items(), q, rate))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0)
                found = [(ids[row].as_py(), *hit) for row, text in enumerate(batch.column(1)) for hit in closest(shared.value, text.as_py())]
                if found:
                    yield T.batch_of(OUT, *(list(c) for c in zip(*found)))

        part = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, start long, end long, edits long")
        if len(blocks_) > 1:
            part = keep(part, "leaks")
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no benchmark passage, row by row, in one pass without a shuffle; with several blocks of
    the benchmark, what is left is written after each."""
    names = docs.columns
    rows = docs.withColumnsRenamed({c: f"_c{n}" for n, c in enumerate(names)})
    text = names.index("text")
    blocks_ = list_blocks(benchmark, block_chars)
    for items in blocks_:
        shared = docs.sparkSession.sparkContext.broadcast(indexes(items(), q, rate))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [next(closest(shared.value, t.as_py()), None) is None for t in batch.column(text)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        rows = rows.mapInArrow(run, rows.schema)
        if len(blocks_) > 1:
            rows = keep(rows, "clean")
            shared.destroy()
    return rows.withColumnsRenamed({f"_c{n}": c for n, c in enumerate(names)})
