"""Quality rules with built-in functions only: base counts, and how far a document is from its language.

Two histograms of a document are compared with its language's by Jensen-Shannon distance: character classes (white space,
A-Z, digits, ``[#*$%&|<>]``, all others) and the ``COMMON`` most frequent words of the language over the corpus (all other
words are one class). The references are counted over all documents, language by language. Documents of under
``MIN_WORDS`` words fail the base rule, and under ``MIN_COMPARED`` the word histogram says too little to be compared; languages of fewer than ``MIN_ROWS`` documents have no reference worth comparing with, and
their documents (like those without a language) pass on the base rules alone.

The references have at most ``COMMON`` rows a language. They are broadcast up to ``MOST_LANGUAGES`` languages, and joined
beyond. Words are ``[^\\x20\\x09-\\x0D]+``. Windows of eight words are compared by 64-bit hashes within a document.

Cases: a null or empty text has no words and fails the base rule; equal rows are judged alike, and each is returned;
a null language is one without a reference; an empty table gives no rows.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import keep

SPACES = "\t\n\x0b\x0c\r"
COMMON, MIN_WORDS, MIN_ROWS = 32, 20, 20
MOST_LANGUAGES = 1000
WINDOW = 8
MIN_COMPARED = 50
MAX_CLASSES, MAX_WORDS = 0.32, 0.52


def words(text: str | Column) -> Column:
    """The words of a text as an array."""
    spaced = reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(" ")), SPACES, F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(spaced, " "), "")


def with_windows(df: DataFrame, tokens: str, name: str) -> DataFrame:
    """``name``: hashes of all windows of eight words, by three doublings; each is a column, so that none is made twice."""
    df, length = df.withColumn("_w1", F.transform(tokens, lambda w: F.xxhash64(w))), 1
    while length < WINDOW:
        here, n = f"_w{length}", F.greatest(F.size(f"_w{length}") - length, F.lit(0))
        both = F.zip_with(F.slice(here, F.lit(1), n), F.slice(here, F.lit(length + 1), n), lambda a, b: F.xxhash64(a, b))
        df, length = df.withColumn(f"_w{2 * length}", both).drop(here), 2 * length
    return df.withColumnRenamed(f"_w{length}", name)


def with_repeated(df: DataFrame, keys: str, name: str) -> DataFrame:
    """``name``: words inside windows that occur twice or more in the document, counted once each."""
    some = F.size(F.array_distinct(keys)) < F.size(keys)
    # equal keys are neighbours after sorting; the places with an equal neighbour are those of repeated windows
    df = df.withColumn("_sorted", F.when(some, F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))))
    pairs = F.zip_with("_sorted", F.slice("_sorted", F.lit(2), F.size("_sorted")), lambda a, b: F.when(a["k"] == b["k"], F.array(a["i"], b["i"])))
    df = df.withColumn("_places", F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))).drop("_sorted")
    steps = F.zip_with("_places", F.slice("_places", F.lit(2), F.size("_places")), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    total = F.aggregate(steps, F.lit(0).cast("long"), lambda sum_, step: sum_ + step)
    return df.withColumn(name, F.coalesce(total, F.lit(0)).cast("long")).drop("_places")


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, lang, mark (names equal rows), the base counts and the counts of character classes."""
    first = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("_text")).withColumns({
        "_words": words("_text"), "_lines": F.filter(F.split("_text", "\n"), lambda line: line.rlike("[^ \\x09-\\x0D]"))})
    second = with_repeated(with_windows(first, "_words", "_keys"), "_keys", "n_repeat_words")
    chars = F.aggregate("_words", F.lit(0).cast("long"), lambda total, w: total + F.length(w))
    return second.select(
        "doc_id", "lang", F.xxhash64("doc_id", "_text").alias("mark"), F.length("_text").cast("long").alias("chars"), F.size("_words").cast("long").alias("n_words"),
        chars.alias("word_chars"), F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.regexp_count("_text", F.lit("[A-Z]")).cast("long").alias("upper"), F.regexp_count("_text", F.lit("[0-9]")).cast("long").alias("digits"))


def classes(sums: bool = False) -> Column:
    """The distribution over character classes as an array, from the counts of a row (or their sums)."""
    of = (lambda c: F.sum(c)) if sums else F.col
    total = F.greatest(of("chars"), F.lit(1))
    space = of("chars") - of("word_chars")
    parts = [space, of("upper"), of("digits"), of("n_symbols")]
    rest = reduce(lambda a, b: a - b, parts, of("chars"))
    return F.array(*(F.greatest(p, F.lit(0)) / total for p in [*parts, rest]))


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two distributions in arrays of one length."""
    def part(a, b):
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    total = F.aggregate(F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a)), F.lit(0.0), lambda x, y: x + y)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def common_words(docs: DataFrame) -> DataFrame:
    """(lang, word, rank, p): the most frequent words of each language and their shares of its words."""
    often = docs.filter("lang is not null").select("lang", F.explode(words("text")).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    totals = often.groupBy("lang").agg(F.sum("n").alias("every"))
    # the most frequent of each bucket first, so that no window holds a language's whole vocabulary
    bucket = Window.partitionBy("lang", F.pmod(F.xxhash64("word"), F.lit(256))).orderBy(F.desc("n"), "word")
    best = often.withColumn("rank", F.row_number().over(bucket)).filter(F.col("rank") <= COMMON)
    top = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("rank") <= COMMON)
    return top.join(totals, "lang").select("lang", "word", "rank", (F.col("n") / F.col("every")).alias("p"))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, class_distance, word_distance (null where there is nothing to compare with) and the verdicts."""
    base = keep(counted(docs), "counts")
    common = keep(common_words(docs), "common")
    languages = base.filter("lang is not null").groupBy("lang").agg(F.count("*").alias("rows"), classes(sums=True).alias("class_ref")).filter(F.col("rows") >= MIN_ROWS)
    few = common.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() <= MOST_LANGUAGES
    hint = F.broadcast if few else (lambda df: df)
    told = (docs.select("lang", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("mark"), F.explode(words("text")).alias("word"))
            .join(hint(common.drop("p")), ["lang", "word"]).groupBy("mark", "rank").agg(F.count("*").alias("n"))
            .groupBy("mark").agg(F.map_from_entries(F.collect_list(F.struct("rank", "n"))).alias("found"), F.sum("n").alias("hits")))
    ref = common.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("rank", "p"))).alias("word_ref"))
    # equal rows have one mark and were counted together, which leaves their shares as they are
    ranks = F.sequence(F.lit(1), F.lit(COMMON))
    refs = languages.join(ref, "lang", "left").select("lang", "class_ref", "word_ref")
    times = base.groupBy("mark").agg(F.count("*").alias("times"))
    rows = base.join(times, "mark").join(told, "mark", "left").join(hint(refs), "lang", "left")

    def filled(found: Column, every: Column) -> Column:
        parts = F.transform(ranks, lambda r: F.coalesce(F.try_element_at(found, r).cast("double"), F.lit(0.0)) / every)
        return F.concat(parts, F.array(F.greatest(F.lit(0.0), 1 - F.aggregate(parts, F.lit(0.0), lambda a, b: a + b))))
    own = filled(F.col("found"), F.greatest(F.col("n_words") * F.col("times"), F.lit(1)))
    them = filled(F.col("word_ref"), F.lit(1.0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = rows.withColumns({"class_distance": F.when(F.col("class_ref").isNotNull(), divergence(classes(), F.col("class_ref"))),
                            "word_distance": F.when(F.col("class_ref").isNotNull() & F.col("word_ref").isNotNull() & (F.col("n_words") >= MIN_COMPARED), divergence(own, them)), "base_failed": failed})
    far = (F.coalesce("class_distance", F.lit(0.0)) > MAX_CLASSES) | (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORDS)
    return out.withColumn("kept", ~F.col("base_failed") & ~far).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")
