"""Language identification by bit-sliced Bloom filters of character n-grams.

One table of slots serves all languages: a slot is a row of bits, one bit per language, so the AND of the slots of
an n-gram names every language whose filter holds it. A document's n-grams are counted language by language
(popcounts of the bit columns), each count is corrected for the filter's false-positive rate, and the largest wins.

N-grams are the bytes of lower-case words with their borders, ``SIZES`` long. A language's filter holds the n-grams
that are at least ``ratio`` times as frequent in it as in the other languages together, the ``grams`` most
frequent of them.

Training rows: at most about ``per_language`` labelled rows of each language, drawn by a hash of the id (the documented
bound of the fit). The table is 2^``slot_bits`` rows of ceil(languages / 64) words, so what is broadcast is bounded by
the number of languages alone. Cases: a text that is null or has no letter is ``und`` with score 0; null languages are not
learned from; with no labelled rows every document is ``und``; ties go to the language that sorts first; rows are never merged.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._scratch import keep
from .toxicity import held_out

SIZES = (3, 4, 5)
PROBES = 2
MOST_LANGUAGES = 10_000
COUNTED = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123)]] = True


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the n-grams of a run of texts. A byte that is neither letter nor wider counts as a border."""
    data = T.LOWER[data]
    code = np.where(data >= 97, data, np.uint8(32)).astype(np.uint64)
    code[(data > 122) & (data < 128)] = 32
    wide = np.full(len(code) + 2, np.uint64(32))
    wide[1:-1] = code
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    rows, keys = [], []
    edge = wide == 32
    gap = np.concatenate([[0], np.cumsum(edge)])
    for size in SIZES:
        n = len(wide) - size + 1
        if n <= 0:
            continue
        key = np.zeros(n, np.uint64)
        for k in range(size):
            key = (key << np.uint64(8)) | wide[k:k + n]
        # borders only at the ends of a gram, so no gram spans two words
        keep = np.flatnonzero((gap[size - 1:size - 1 + n] - gap[1:1 + n]) == 0)
        mid = np.clip(keep, 0, len(row) - 1)              # the second character of a gram is the text's at this place
        keys.append(T.mix(key[keep] + (np.uint64(size) << np.uint64(56))))
        rows.append(row[mid])
    return np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, gram, n), counted in each task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs])
            parts: list[list[np.ndarray]] = [[] for _ in names]
            for lo, hi, data, at in T.runs(batch.column(1)):
                row, key = grams(data, at)
                own = number[lo:hi][row]
                for k in range(len(names)):
                    parts[k].append(key[own == k])
            for name, part in zip(names, parts):
                key, n = np.unique(np.concatenate(part), return_counts=True)
                yield T.batch_of(COUNTED, [name] * len(key), T.signed(key), n)

    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filters:
    """The slots, the languages and their false-positive rates."""

    def __init__(self, names: list[str], grams_of: list[np.ndarray], slot_bits: int):
        self.names, self.bits = names, slot_bits
        words = max(1, -(-len(names) // 64))
        self.slots = np.zeros((1 << slot_bits, words), np.uint64)
        self.false = np.zeros(len(names))
        for n, keys in enumerate(grams_of):
            bit = np.uint64(1) << np.uint64(n % 64)
            for at in self.places(keys):
                self.slots[at, n // 64] |= bit
            full = np.count_nonzero(self.slots[:, n // 64] & bit) / len(self.slots)
            self.false[n] = full ** PROBES

    def places(self, keys: np.ndarray) -> list[np.ndarray]:
        shift = np.uint64(64 - self.bits)
        return [((keys << np.uint64(probe * self.bits)) >> shift).astype(np.int64) for probe in range(PROBES)]

    def counts(self, row: np.ndarray, keys: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Corrected counts (rows x languages) and the number of n-grams of each row."""
        total = np.bincount(row, minlength=rows)
        places = self.places(keys)
        found = np.zeros((rows, len(self.names)))
        for word in range(self.slots.shape[1]):
            column = self.slots[:, word]
            mask = column[places[0]]
            for at in places[1:]:
                mask &= column[at]
            some = np.flatnonzero(mask)
            mask, own = mask[some], row[some]
            for n in range(64 * word, min(64 * word + 64, len(self.names))):
                found[:, n] = np.bincount(own[(mask >> np.uint64(n % 64)) & np.uint64(1) == 1], minlength=rows)
        return np.clip((found - total[:, None] * self.false) / (1 - self.false), 0, None), total


def fit(docs: DataFrame, *, per_language: int = 2000, grams_kept: int = 20_000, ratio: float = 3.0, slot_bits: int = 20) -> Filters:
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("lang")), 11).alias("draw"))
    sizes = keep(known.groupBy("lang").agg(F.count("*").alias("rows")), "languages")
    # one row a language: broadcast up to a checked number, so that no text is dealt out by its language
    few = sizes.count() <= MOST_LANGUAGES
    chosen = known.join(F.broadcast(sizes) if few else sizes, "lang").filter(F.col("draw") < F.lit(float(1 << 53)) * F.lit(per_language) / F.col("rows"))
    counted = count_grams(chosen.select("lang", "text"))
    shares = counted.join(counted.groupBy("lang").agg(F.sum("n").alias("own")), "lang").withColumn("share", F.col("n") / F.col("own"))
    everywhere = shares.groupBy("gram").agg(F.sum("share").alias("all_shares"))
    rare = shares.join(everywhere, "gram").filter((F.col("share") >= ratio * (F.col("all_shares") - F.col("share"))) & (F.col("n") > 1))
    # the sample bounds a language's n-grams, and the rank keeps the table's size
    best = rare.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("_rank") <= grams_kept)
    table = best.select("lang", "gram").toArrow()
    lang = np.array(table.column("lang").to_pylist(), object)
    key = table.column("gram").to_numpy().view(np.uint64)
    names = sorted(set(lang))
    return Filters(names, [key[lang == name] for name in names], slot_bits)


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, lang_pred, score) of every row: the winner's share of the corrected counts."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array([*own.names, "und"], object)
        for batch in batches:
            found, score = np.full(batch.num_rows, len(own.names)), np.zeros(batch.num_rows)
            for lo, hi, data, at in T.runs(batch.column(1)):
                ascii_letters = np.concatenate([[0], np.cumsum(LETTERS[data])])
                lettered = ascii_letters[at[1:]] > ascii_letters[at[:-1]]
                for k in np.flatnonzero(~lettered):
                    lettered[k] = any(map(str.isalpha, batch.column(1)[lo + int(k)].as_py() or ""))
                if own.names:
                    row, key = grams(data, at)
                    count, _ = own.counts(row, key, hi - lo)
                    best, every = count.argmax(1), count.sum(1)
                    found[lo:hi] = np.where(lettered, best, len(own.names))
                    score[lo:hi] = np.where(lettered, np.where(every > 0, count.max(1) / np.maximum(every, 1e-12), 1 / len(own.names)), 0.0)
            yield T.batch_of(schema, batch.column(0).cast(pa.int64()), list(names[found]), np.clip(score, 0, 1))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score; learns from the rows that are not held out."""
    filters = fit(docs.filter(~held_out("doc_id", 3, 1)), **options)
    return predict(docs, filters).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")
