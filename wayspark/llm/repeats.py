"""Words covered by windows that repeat anywhere in the corpus, by level-wise doubling.

Level one counts short windows (half the asked length, rounded up); only those that repeat are extended to twice
that length, where the rest is decided. Two means keep the levels small without losing a window:

* Anchors. Equal long windows hold the same short windows, so both have the same smallest short-window hash at the
  same offset. Only these anchors take part in level one, about one in ten windows.
* Segments. The long windows of one anchor are consecutive and form one segment. Equal segments decide all their
  windows at once. Only where one anchor has several different segments are the windows extended one by one,
  from one occurrence of each segment, so copies cost no more than one of them.

No window is dropped or sampled. Keys are 64-bit hashes of anchors with 64-bit hashes of segments or windows. Heavy
keys are pre-aggregated before each shuffle, and joins back are ones that adaptive execution may split.

Cases: a null text has no words; texts shorter than the window keep everything; empty texts keep nothing and lose
nothing; exact copies of a long enough text lose all words; rows are told apart by their id and a hash of the text,
with equal rows numbered together, so repeated rows count as occurrences of each other.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._scratch import drop, keep

ANCHOR = pa.schema([("anchor", pa.int64()), ("segment", pa.int64()), ("row", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
WINDOW = pa.schema([("window", pa.int64()), ("row", pa.int64()), ("at", pa.int32()), ("asked", pa.bool_())])


def smallest(key: np.ndarray, span: int) -> np.ndarray:
    """Position of the leftmost smallest of ``span`` consecutive keys, for every start."""
    at, width = np.arange(len(key), dtype=np.int64), 1
    while width < span:
        step = min(width, span - width)
        if len(at) <= step:
            return at[:0]
        left, right = at[:-step], at[step:]
        at = np.where(key[left] <= key[right], left, right)
        width += step
    return at


def segments(data: np.ndarray, at: np.ndarray, short: int, long: int):
    """(row in run, anchor, segment, first window, last window) of every anchor; windows count from the row's first word."""
    starts, ends, first = T.words(data, at, T.SPACES)
    n = len(starts) - long + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, none
    codes = T.Prefix(T.word_codes(data, starts, ends), T.WORD_BASE)
    key = codes.windows(short)
    best = smallest(key, long - short + 1)[:n]
    row = T.owner(first)
    whole = np.flatnonzero(row[:n] == row[long - 1:])
    if not len(whole):
        return none, none, none, none, none
    lead, own = best[whole], row[whole]
    new = np.append(True, (lead[1:] != lead[:-1]) | (own[1:] != own[:-1]))
    lo = whole[new]
    hi = whole[np.append(np.flatnonzero(new)[1:], len(whole)) - 1]
    lead, own = lead[new], own[new]
    body = codes.spans(lo, hi + long)
    shape = (lead - lo).astype(np.uint64) * np.uint64(1 << 20) + (hi - lo).astype(np.uint64)
    return own, key[lead], T.mix(body + shape * np.uint64(T.BYTE_BASE)), lo - first[own], hi - first[own]


def anchors(rows: DataFrame, short: int, long: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, hi, data, at in T.runs(batch.column(1)):
                own, anchor, segment, first, last = segments(data, at, short, long)
                if len(own):
                    yield T.batch_of(ANCHOR, T.signed(anchor), T.signed(segment), ids[lo:hi][own], first.astype(np.int32), last.astype(np.int32))

    return rows.mapInArrow(run, "anchor long, segment long, row long, first int, last int")


def windows(rows: DataFrame, long: int) -> DataFrame:
    """(window, row, at, asked) of the long windows in the ranges ``spots`` (first, last, asked) of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spots = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            for lo, hi, data, at in T.runs(batch.column(1)):
                starts, ends, first = T.words(data, at, T.SPACES)
                key = T.Prefix(T.word_codes(data, starts, ends), T.WORD_BASE).windows(long)
                for k in range(lo, hi):
                    a = np.array([s["first"] for s in spots[k]])
                    n = np.array([s["last"] for s in spots[k]]) - a + 1
                    place = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
                    yield T.batch_of(WINDOW, T.signed(key[first[k - lo] + place]), np.full(len(place), ids[k]), place.astype(np.int32),
                                     np.repeat([s["asked"] for s in spots[k]], n))

    return rows.mapInArrow(run, "window long, row long, at int, asked boolean")


def repeated_spans(rows: DataFrame, length: int) -> DataFrame:
    """(row, first, last): runs of windows of ``length`` words that also start elsewhere. ``rows`` is (row long, text), row unique."""
    short = -(-length // 2)
    found = anchors(rows, short, length)
    # most anchors occur once: what is left of them is a count, and only the others are grouped, joined and written
    often = keep(found.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("anchor"), "anchors")
    found = keep(found.join(often, "anchor", "left_semi"), "repeated")
    drop(often)
    kinds = found.groupBy("anchor", "segment").agg(F.count("*").alias("copies"), F.min(F.struct("row", "first", "last")).alias("one"))
    kinds = keep(kinds.groupBy("anchor").agg(F.count("*").alias("segments")).join(kinds, "anchor").select("anchor", "segment", "copies", "segments", "one"), "segments")
    full = found.join(kinds.filter(F.col("copies") > 1).select("anchor", "segment"), ["anchor", "segment"]).select("row", "first", "last")
    # extend: one occurrence of each segment whose anchor has others; only lone segments still ask for an answer
    spots = (kinds.filter(F.col("segments") > 1).select("one.row", F.struct("one.first", "one.last", (F.col("copies") == 1).alias("asked")).alias("spot"))
             .groupBy("row").agg(F.collect_list("spot").alias("spots")))
    longer = windows(rows.join(spots, "row").select("row", "text", "spots"), length)
    known = longer.groupBy("window").agg(F.count("*").alias("n"), F.max("asked").alias("any")).filter((F.col("n") > 1) & F.col("any")).select("window")
    single = longer.filter("asked").join(known, "window").select("row", F.col("at").alias("first"), F.col("at").alias("last"))
    return full.unionByName(single)


REMOVED = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _covered(spots: list | None, length: int, n: int) -> np.ndarray:
    marks = np.zeros(n + 1, np.int64)
    if spots:
        np.add.at(marks, [s["first"] for s in spots], 1)
        np.add.at(marks, [s["last"] + length for s in spots], -1)
    return np.cumsum(marks)[:n] > 0


def remove_repeats(docs: DataFrame, *, length: int = 35, text: str = "text", joined: bool = False) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept`` appended: the text without the covered words. A text that loses
    nothing keeps its white space; otherwise each word takes along the white space before it (``joined``: one space). Columns of these names in ``docs`` are
    an error, raised at once."""
    names = docs.columns
    if clash := {*REMOVED.names} & {*names}:
        raise ValueError(f"the input already has {sorted(clash)}")
    named = docs.withColumnsRenamed({c: f"_c{n}" for n, c in enumerate(names)})
    body = F.col(f"_c{names.index(text)}")
    # a row number would need an order; the hash of all columns names a row, and equal rows are numbered by a count
    key = F.xxhash64(*(F.col(f"_c{n}").cast("string") for n in range(len(names))))
    rows = named.withColumn("row", key)
    many = rows.groupBy("row").count().filter("count > 1").select("row")
    own = rows.select("row", body.alias("text"))
    if many.take(1):
        # further rows that are equal in every column have no key of their own: two of them stand for all
        twice = own.join(many, "row").dropDuplicates(["row"])
        own = own.join(many, "row", "left_anti").unionByName(twice).unionByName(twice.withColumn("row", F.col("row") + F.lit(1)))
    spots = repeated_spans(own, length).groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("_spots"))
    joined_rows = rows.join(spots, "row", "left").select(*named.columns, "_spots")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema.fields)
    at_text = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots_, texts = batch.column(len(names)), batch.column(at_text)
            total, removed, kept = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), []
            for lo, hi, data, at in T.runs(texts):
                starts, ends, first = T.words(data, at, T.SPACES)
                total[lo:hi] = np.diff(first)
                raw = data.tobytes()
                for k in range(lo, hi):
                    own = slice(first[k - lo], first[k - lo + 1])
                    spot = spots_[k].as_py()
                    covered = _covered(spot, length, int(total[k])) if spot else None
                    removed[k] = 0 if covered is None else covered.sum()
                    if covered is None and not joined:
                        kept.append(texts[k].as_py())
                        continue
                    s, e = starts[own], ends[own]
                    stay = np.arange(len(s)) if covered is None else np.flatnonzero(~covered)
                    if joined:
                        kept.append(" ".join([raw[a:b].decode() for a, b in zip(s[stay].tolist(), e[stay].tolist())]))
                    else:
                        before = np.append(at[k - lo], e[:-1])
                        kept.append("".join([raw[a:b].decode() for a, b in zip(before[stay].tolist(), e[stay].tolist())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, f.type) for c, f in zip((total, removed, kept), REMOVED))],
                                             names=[*(f"_c{n}" for n in range(len(names))), *REMOVED.names])

    out = joined_rows.mapInArrow(run, f"{fields}, n_words long, n_removed long, kept string")
    return out.withColumnsRenamed({f"_c{n}": c for n, c in enumerate(names)})


def digest(docs: DataFrame, *, length: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    out = remove_repeats(docs.select("doc_id", "text"), length=length, joined=True)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute_force(texts: list[tuple[int, str | None]], length: int) -> list[tuple[int, int, int, str]]:
    """The same digests from a dictionary of all windows, for tests."""
    split = [(key, [w for w in _split(text)]) for key, text in texts]
    seen: dict[tuple, int] = {}
    for _, w in split:
        for i in range(len(w) - length + 1):
            seen[tuple(w[i:i + length])] = seen.get(tuple(w[i:i + length]), 0) + 1
    out = []
    for key, w in split:
        gone = {j for i in range(len(w) - length + 1) if seen[tuple(w[i:i + length])] > 1 for j in range(i, i + length)}
        left = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out


def _split(text: str | None) -> list[str]:
    import re
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
