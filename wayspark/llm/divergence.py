"""Source divergence audit: how far the term rates of the sources of a language lie apart, and which terms tell a source.

1. Terms (runs of letters and wider characters, A-Z lower-cased) are counted by language and source in the map tasks,
   in counters of bounded size; only their sums are shuffled, once, by language and term. A term that stands in at least
   ``least_docs`` documents of a language is kept.
2. A kept term is a row of the counts that are not zero, in the order of the sources. Equal rows become one row with its
   multiplicity, and the rows, sorted, are the frequent-pattern tree in depth-first order: rows with a common beginning
   pass through the same nodes, and a node's multiplicity is the sum of its rows'. Ranges of the sorted rows are the
   subtrees of the tasks; a batch holds some of them, never the tree.
3. With b a source's rate of an absent term and p that of a count, the distance of two sources over all kept terms is
   V * |b - b'|, plus what every count changes in one source alone (from the histogram of counts), plus, where
   both counts are there, |p - p'| - |p - b'| - |b - p'| + |b - b'|: summed once for each node and ancestor, times the
   node's multiplicity. So absent counts cost nothing, and terms with a common beginning are paid once.

All arithmetic is exact: rates by decimal division, sums in whole numbers. The table of (language, source) groups is
broadcast where it has at most ``SMALL`` rows, and joined otherwise.

Cases: null text, language or source is ''; a group without kept terms has rate 5 / (5 * V) for every term; a language
without kept terms has distance 0 between its sources; a language with one source has no pairs; repeated rows are
documents of their own; extra columns are not read; a text of any length is counted in stretches; an empty table gives no rows.
"""
from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import drop, keep

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
BREAK = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
STRETCH = 1 << 20       # bytes of a text that are cut into terms at a time
ENTRIES = 300_000       # terms that the counters of a task hold before they are handed on
PAIRS = 1 << 20         # node-ancestor pairs in memory
SMALL = 100_000         # groups that may be broadcast

COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
SUMS = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("both", pa.int64())])


def stretches(data: bytes) -> Iterator[bytes]:
    """Pieces of about ``STRETCH`` bytes, cut between terms."""
    at = 0
    while len(data) - at > STRETCH:
        cut = BREAK.search(data, at + STRETCH)
        if cut is None:
            break
        yield data[at:cut.start()]
        at = cut.start()
    yield data[at:]


def _handed_on(counts: dict, docs: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), own in counts.items():
        if own:
            terms, n = pa.array(list(own), pa.binary()).cast(pa.string()), len(own)
            also = docs[lang, source]
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), n), pa.repeat(pa.scalar(source, pa.string()), n), terms,
                                              pa.array(list(own.values()), pa.int64()), pa.array([also[t] for t in own], pa.int64())], schema=COUNTED)


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents by language, source and term; a term may come more than once."""
    counts, docs, held = defaultdict(Counter), defaultdict(Counter), 0
    for batch in batches:
        for text, *group in zip(*(batch.column(i).to_pylist() for i in (2, 0, 1))):
            if not text:
                continue
            own, seen = counts[tuple(group)], set()
            held -= len(own)
            for piece in stretches(text.encode().lower()):          # of bytes: A-Z only
                terms = TERM.findall(piece)
                own.update(terms)
                seen.update(terms)
            docs[tuple(group)].update(seen)
            held += len(own)
            if held > ENTRIES:
                yield from _handed_on(counts, docs)
                counts.clear(), docs.clear()
                held = 0
    yield from _handed_on(counts, docs)


def rate(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 kept)), exactly."""
    whole = [c.cast("decimal(20,0)") for c in (n + 5, total + 5 * kept)]
    return F.lit(1) + F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * whole[0], whole[1])


def kept_terms(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, total, counts): the counts of the sources where the term occurs."""
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), "text")
    rows = named.mapInArrow(count_terms, "lang string, source string, term string, n long, docs long")
    # one exchange serves both groupings; a term's rows are as many as tasks and sources, not documents
    sums = rows.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return (sums.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("counts"))
            .filter(F.col("docs") >= least_docs).drop("docs"))


def group_table(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row per (lang, source): its number in the language, totals of it and of the language, kept terms and the rate of an absent term."""
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sums = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("own"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("V"), F.sum("total").alias("whole"))
    rows = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["own", "V", "whole"])
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source"))
    return rows.withColumns({"number": number, "absent": F.when(F.col("V") > 0, rate(F.lit(0), F.col("own"), F.col("V"))).otherwise(0)})


def tree_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (lang, path, times) in order: for each pair of sources, the sum over the tree's nodes and their ancestors."""
    for batch in batches:
        if not batch.num_rows:
            continue
        langs, paths = batch.column(0).dictionary_encode(), batch.column(1)
        lang, times, size = langs.indices.to_numpy(), batch.column(2).to_numpy(), np.diff(paths.offsets.to_numpy())
        source, n, p, absent = (x.to_numpy() for x in paths.flatten().flatten())
        start = np.append(0, np.cumsum(size)[:-1])
        row = np.repeat(np.arange(len(size)), size)
        depth = np.arange(len(row)) - start[row]
        # the number of leading items that a row shares with the one before it
        above = np.maximum(row - 1, 0)
        same = (row > 0) & (depth < size[above]) & (lang[above] == lang[row])
        at = np.where(same, start[above] + depth, 0)
        same &= (source[at] == source) & (n[at] == n)
        shared = np.minimum.reduceat(np.where(same, size[row], depth), start)
        order = np.argsort(depth, kind="stable")
        first = np.flatnonzero((depth >= shared[row])[order])
        node, weight = order[first], np.add.reduceat(times[row[order]], first)
        ends = np.cumsum(depth[node])
        at, done = 0, 0
        while at < len(node):
            to = max(at + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
            k, w = node[at:to], weight[at:to]
            many = depth[k]
            low = np.repeat(k, many)
            up = np.repeat(start[row[k]], many) + np.arange(len(low)) - np.repeat(np.cumsum(many) - many, many)
            change = np.abs(p[up] - p[low]) - np.abs(p[up] - absent[low]) - np.abs(absent[up] - p[low]) + np.abs(absent[up] - absent[low])
            width = int(source.max()) + 1
            keys, which = np.unique((lang[row[low]].astype(np.int64) * width + source[up]) * width + source[low], return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, which, change * np.repeat(w, many))
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(keys // width // width)), pa.array((keys // width % width).astype(np.int32)),
                                              pa.array((keys % width).astype(np.int32)), pa.array(sums)], schema=SUMS)
            at, done = to, ends[to - 1]


def audit(docs: DataFrame, *, least_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair``, the distance to every other source of the language; part
    ``term``, the ``top`` terms whose rate in the group exceeds the language's, by the excess."""
    kept = keep(kept_terms(docs, least_docs), "terms")
    groups = keep(group_table(docs, kept), "groups")
    small = F.broadcast(groups) if groups.count() <= SMALL else groups
    counts = kept.select("lang", "term", "total", F.explode("counts").alias("c")).select("lang", "term", "total", "c.source", "c.n").join(small, ["lang", "source"])
    entries = keep(counts.select("lang", "source", "term", "n", "number", "absent", rate(F.col("n"), F.col("own"), F.col("V")).alias("p"),
                                 rate(F.col("total"), F.col("whole"), F.col("V")).alias("q")), "entries")
    drop(kept)

    path = F.sort_array(F.collect_list(F.struct("number", "n", "p", "absent")))
    paths = keep(entries.groupBy("lang", "term").agg(path.alias("path")).groupBy("lang", "path").agg(F.count("*").alias("times")), "paths")
    # sources and counts alone decide the order, so the sample that finds the ranges holds no rates
    key = F.flatten(F.transform("path", lambda i: F.array(i["number"].cast("long"), i["n"]))).alias("key")
    ordered = paths.select("lang", key, "path", "times").repartitionByRange("lang", "key").sortWithinPartitions("lang", "key")
    both = ordered.select("lang", "path", "times").mapInArrow(tree_sums, "lang string, a int, b int, both long").groupBy("lang", "a", "b").agg(F.sum("both").alias("both"))

    other = groups.select("lang", F.col("number").alias("to"), F.col("source").alias("item"), F.col("absent").alias("level"))
    other = F.broadcast(other) if small is not groups else other
    alone = F.abs(F.col("p") - F.col("level")) - F.abs(F.col("absent") - F.col("level"))
    histogram = entries.groupBy("lang", "number", "p", "absent").agg(F.count("*").alias("times"))
    single = (histogram.join(other, "lang").filter("number <> to").groupBy("lang", F.least("number", "to").alias("a"), F.greatest("number", "to").alias("b"))
              .agg(F.sum(alone * F.col("times")).alias("single")))

    pairs = groups.select("lang", "source", "number", "V", "absent").join(other, "lang").filter("number <> to")
    pairs = pairs.withColumns({"a": F.least("number", "to"), "b": F.greatest("number", "to")}).join(single, ["lang", "a", "b"], "left").join(both, ["lang", "a", "b"], "left")
    value = F.col("V") * F.abs(F.col("absent") - F.col("level")) + F.coalesce("single", F.lit(0)) + F.coalesce("both", F.lit(0))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    far = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", F.row_number().over(by_value))
    telling = entries.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return far.unionByName(telling.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top))


SQL = """
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                     regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
words AS (SELECT id, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(total) AS whole FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
sums AS (SELECT lang, source, sum(n) AS own FROM counts GROUP BY lang, source),
rates AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(s.own, 0) + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.total + 5)) // (l.whole + 5 * l.v) AS q
          FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN sums s USING (lang, source) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM rates a JOIN rates b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
          UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM rates WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM parts
QUALIFY part = 'pair' OR rank <= 50
"""
