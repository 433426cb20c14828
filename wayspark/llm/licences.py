"""Licence scans with built-in functions only: a positional index of rare licence words.

The index holds, for every word of the licence templates, the templates and the positions where it stands. A file looks up the
rarest word of each mandatory key phrase (``anchors``), so that every key phrase that stands has a posting, and of its other
licence words the ``LOOKED_UP`` of highest inverse document frequency (counted over all files); each place where such a word
stands, less the word's position in a template, is the place where that template would begin. Places of different words that
agree are one hit. A hit counts when one of the template's mandatory key phrases stands just where the template says.

Base places (``PHRASES``) are found in the words themselves, whatever the index says. Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``
after A-Z became a-z. ``score`` is the largest share of a template's words that stand in their places, 1 where a base phrase
stands, 0 where nothing does. The index and the word list come from the templates below; both are of fixed size.

Cases: a null text is empty; an empty text has no words, no places and empty labels; equal rows give equal results, each is
returned; phrases at the very start or end of a text count; an empty table gives no rows.
"""
from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases and labels of the base places.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Notices as their licences word them (label, text, mandatory key phrases).
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("apache", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("gpl", "licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4",)),
    ("reserved", "all rights reserved", ("all rights reserved",)),
)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOOKED_UP = 12


def vocabulary() -> list[str]:
    return sorted({w for _, text, _ in TEMPLATES for w in text.split()})


def openers() -> list[str]:
    """One word of each phrase without which neither a base place nor a verified hit can be: the longest one."""
    phrases = [p for p, _ in PHRASES] + [k for _, _, keys in TEMPLATES for k in keys]
    return sorted({max(p.split(), key=len) for p in phrases})


def anchors(frequency: dict[str, int]) -> list[str]:
    """The rarest word of each mandatory key phrase; where a phrase stands, its word does."""
    return sorted({min(k.split(), key=lambda w: (frequency.get(w, 0), w)) for _, _, keys in TEMPLATES for k in keys})


def lowered(text: str = "text") -> Column:
    # beyond A-Z this changes letters of wider alphabets only, which are word characters before and after
    return F.lower(F.coalesce(F.col(text), F.lit("")))


def stands(words: Column, phrase: list[str]) -> Column:
    """Positions (from 0) where the phrase's words stand consecutively."""
    first = F.filter(F.transform(words, lambda w, i: F.when(w == phrase[0], i)), lambda i: i.isNotNull())
    return F.filter(first, lambda i: F.slice(words, i + 1, len(phrase)) == F.array(*map(F.lit, phrase)))


def labels(*found: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.array(*found)))), ",")


def templates_table(spark) -> DataFrame:
    """(word, template, at): the positional index."""
    return spark.createDataFrame([(w, n, at) for n, (_, text, _) in enumerate(TEMPLATES) for at, w in enumerate(text.split())], "word string, template int, at int")


def hits(named: DataFrame) -> DataFrame:
    """(mark, found, best): labels of the verified templates of each candidate file, and the largest share of matched words."""
    spark = named.sparkSession
    known = F.array(*map(F.lit, vocabulary()))
    frequency = {r["word"]: r["n"] for r in named.select(F.explode(F.array_intersect(known, F.col("words"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    rare_first = sorted(frequency, key=lambda w: (frequency[w], w))
    if not rare_first:
        rare_first = vocabulary()
    always = anchors(frequency)
    others = F.array(*map(F.lit, [w for w in rare_first if w not in always])).cast("array<string>")
    looked = F.concat(F.array(*map(F.lit, always)), F.slice(F.array_intersect(others, F.col("words")), 1, LOOKED_UP))
    placed = named.withColumn("looked", looked).select("mark", F.explode(F.filter(F.transform(
        "words", lambda w, i: F.struct(w.alias("word"), i.alias("pos"))), lambda p: F.array_contains("looked", p["word"]))).alias("p")).select("mark", "p.*")
    starts = (placed.join(F.broadcast(templates_table(spark)), "word").groupBy("mark", "template", (F.col("pos") - F.col("at")).alias("start"))
              .agg(F.countDistinct("at").alias("agree")))
    # one hit for each template and place; the verification needs the words again, once for each file
    per_file = starts.groupBy("mark").agg(F.collect_list(F.struct("template", "start", "agree")).alias("starts"))
    texts = F.array(*(F.array(*map(F.lit, text.split())) for _, text, _ in TEMPLATES))
    keys = F.array(*(F.array(*(F.struct(F.lit(text.split().index(k.split()[0], _place(text, k))).alias("at"), F.array(*map(F.lit, k.split())).alias("words")) for k in own))
                     for _, text, own in TEMPLATES))
    names = F.array(*(F.lit(label) for label, _, _ in TEMPLATES))
    n = F.size("words")

    def verified(s: Column) -> Column:
        return F.exists(F.get(keys, s["template"]), lambda k: (s["start"] + k["at"] >= 0) & (F.slice("words", F.greatest(s["start"] + k["at"] + 1, F.lit(1)), F.size(k["words"])) == k["words"]))

    def share(s: Column) -> Column:
        text = F.get(texts, s["template"])
        same = F.filter(F.transform(text, lambda w, i: (s["start"] + i >= 0) & (s["start"] + i < n) & (F.get("words", F.greatest(s["start"] + i, F.lit(0))) == w)), lambda x: F.coalesce(x, F.lit(False)))
        return F.size(same) / F.size(text)
    joined = named.dropDuplicates(["mark"]).join(per_file, "mark").withColumn("good", F.filter("starts", verified))
    return joined.select("mark", F.array_distinct(F.transform("good", lambda s: F.get(names, s["template"]))).alias("found"),
                         F.coalesce(F.array_max(F.transform("good", share)), F.lit(0.0)).alias("best"))


def _place(text: str, phrase: str) -> int:
    return len(text[:text.index(phrase)].split())


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    low = docs.select("doc_id", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("mark"), lowered().alias("low"))
    may = reduce(lambda a, b: a | b, (F.contains("low", F.lit(w)) for w in openers()))
    cut = low.select("doc_id", "mark", F.regexp_count("low", F.lit(WORD)).cast("long").alias("n_words"), F.when(may, F.regexp_extract_all("low", F.lit(f"({WORD})"))).alias("words"))
    places = cut.withColumns({f"_p{n}": stands(F.col("words"), phrase.split()) for n, (phrase, _) in enumerate(PHRASES)})
    some = F.flatten(F.array(*(F.coalesce(f"_p{n}", F.array().cast("array<int>")) for n in range(len(PHRASES)))))
    base = F.filter(F.array(*(F.when(F.size(f"_p{n}") > 0, F.lit(label)) for n, (_, label) in enumerate(PHRASES))), lambda x: x.isNotNull())
    counted = places.select("doc_id", "mark", "n_words", some.alias("_all"), base.alias("_base"))
    found = hits(cut.filter(F.col("words").isNotNull()).select("mark", "words"))
    none = F.array().cast("array<string>")
    return counted.join(found, "mark", "left").select(
        "doc_id", "n_words", F.size("_all").cast("long").alias("n_base"), F.array_min("_all").cast("long").alias("first_word"), F.array_max("_all").cast("long").alias("last_word"),
        labels(F.col("_base")).alias("base_labels"), labels(F.col("_base"), F.coalesce("found", none)).alias("labels"),
        F.when(F.size("_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def brute_force(text: str | None) -> tuple[int, list[int], set[str]]:
    """(words, starts of base places, base labels) of one text, for tests."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(WORD, low)
    places, names = [], set()
    for phrase, label in PHRASES:
        own = phrase.split()
        at = [i for i in range(len(words)) if words[i:i + len(own)] == own]
        places += at
        names |= {label} if at else set()
    return len(words), sorted(places), names
