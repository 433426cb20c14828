"""Token counts of whole texts by a two-tier lookup, map-side only.

A SentencePiece vocabulary in which white space occurs only at the start of a piece (or alone) never merges
across the border before a run of spaces, so a text's count is the sum over its pre-tokens (``border`` checks this and
the normaliser on loading, and refuses other models). Tier one is a broadcast table of the lengths of frequent
pre-tokens; its size is bounded by ``frequent`` entries of at most ``LONGEST`` characters. Tier two encodes misses with the
library and keeps them in the worker's cache, which is emptied when it holds ``cache`` entries. Neither tier changes a count.

The frequent pre-tokens come from a mergeable heavy-hitter sketch over the whole corpus: every task keeps a bounded
summary, and summaries, not pre-tokens, are merged in two levels.

Cases: a null text is empty and has 0 tokens; pre-tokens longer than ``LONGEST`` are encoded but not kept; special
strings inside texts are ordinary text, as the library treats them; repeated rows and null ids are kept as they are.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONGEST = 48
SPACE = "▁"
PRE_TOKEN = re.compile(r" +[^ ]*")
COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def library_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load(name: str):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=library_path(name))
    border(model)
    return model


def border(model) -> None:
    """Raises unless pre-tokens can be counted one by one."""
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
        raise ValueError("a piece crosses the border before a space")
    for text in ("a  b", " a", "a ", "　ﬁ\n\t", "Á"):
        if "".join(model.encode(text, out_type=str)).replace(SPACE, " ") != " " + text and "<0x" not in "".join(model.encode(text, out_type=str)):
            raise ValueError("the model's normaliser changes texts")


def pre_tokens(text: str) -> list[str]:
    """Runs of spaces with the characters behind them; the text gets the space that the library puts before it."""
    return PRE_TOKEN.findall(" " + text.replace(SPACE, " ")) if text else []


def frequent_lengths(docs: DataFrame, tokenizer: str, frequent: int = 8192) -> dict[str, int]:
    """Lengths of the pre-tokens that a sketch over all texts finds frequent."""
    token = F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("token")
    # one sketch per task and group of tasks, then one of all groups
    rows = docs.select((F.spark_partition_id() % 64).alias("part"), token).filter(F.length("token").between(1, LONGEST - 1))
    parts = rows.groupBy("part").agg(F.expr(f"approx_top_k_accumulate(token, {4 * frequent})").alias("sketch"))
    merged = parts.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(sketch, {4 * frequent})").alias("sketch"))       # no row where there are no texts
    top = [item for row in merged.select(F.expr(f"approx_top_k_estimate(sketch, {frequent})").alias("top")).collect() for item in row["top"]]
    model = load(tokenizer)
    found = [r["item"] for r in top if SPACE not in r["item"]]
    return dict(zip((" " + t for t in found), map(len, model.encode(found, num_threads=1))))


def count_tokens(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model", *, frequent: int = 8192, cache: int = 200_000) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, tokenizer, frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, near = load(tokenizer), table.value
        misses: dict[str, int] = {}
        for batch in batches:
            sizes, counts = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for row, text in enumerate(batch.column(1).to_pylist()):
                if not text:
                    continue
                sizes[row] = len(text.encode())
                cut = pre_tokens(text)
                unknown = list({t for t in cut if t not in near and t not in misses})
                if unknown:
                    if len(misses) + len(unknown) > cache:
                        misses = {}
                        unknown = list({t for t in cut if t not in near})
                    # the library puts the first space back, but not before nothing: a last space alone is one token
                    misses.update((t, len(ids) or 1) for t, ids in zip(unknown, model.encode([t[1:] for t in unknown], num_threads=1)))
                counts[row] = sum([near[t] if t in near else misses[t] for t in cut])
            misses = {t: n for t, n in misses.items() if len(t) <= LONGEST} if any(len(t) > LONGEST for t in misses) else misses
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes), pa.array(counts)], schema=COUNTS)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
