"""Near duplicates: documents whose sets of five-word n-grams have a Jaccard similarity of 0.8 or more.

1. One pass gives each document a hash of its n-gram set and a MinHash signature. Documents with the same set are one
   class; only class representatives go on, with the class size.
2. Signatures are cut into bands (``banding`` chooses bands and rows for the target recall) and shuffled on the band hash.
   Members of a shared band are compared by signature in blocks; a block reports only the links that connect it
   (at most one for each member), never its pairs.
3. Connected components over these links are the families. Each family's n-gram sets are brought together once, in
   blocks of at most ``BLOCK`` documents, and *all* its pairs are verified on the full sets by a product of sparse
   columns. So a pair counts whether or not it shares a band. What leaves a block is one count per document and
   again at most one link for each member.
4. Components over the verified links are the near-duplicate classes.

Links and components stay distributed throughout. A family of n different texts costs n/BLOCK copies of each set and
n^2 comparisons in bounded blocks: that many links have to be counted, and no task holds more than two blocks.

Cases: words are ``[^\\x20\\x09-\\x0D]+``; a text of one to four words is one n-gram; texts without words (null, empty) have no
set and are classes of their own; exact copies are linked to each other; repeated rows of one id share its class.
"""
from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._groups import dealt, groups
from ._scratch import drop, keep

BLOCK = 512
CELLS = 1 << 21


@functools.lru_cache(maxsize=None)
def banding(similarity: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows, hence the fewest false candidates, that reach the recall with at most ``most`` hashes."""
    best = (most, 1)
    for rows in range(1, 9):
        miss, bands = 1 - similarity ** rows, 1
        while miss ** bands > 1 - recall:
            bands += 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


def ngram_sets(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each row, row after row and sorted, with the rows' places."""
    starts, ends, first = T.words(data, at, T.SPACES)
    codes = T.Prefix(T.word_codes(data, starts, ends), T.WORD_BASE)
    key, row = codes.windows(size), T.owner(first)
    same = row[:len(key)] == row[size - 1:] if len(key) else np.zeros(0, bool)
    key, own = key[same], row[:len(same)][same]
    count = np.diff(first)
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        key = np.concatenate([key, codes.spans(first[few], first[few + 1])])
        own = np.concatenate([own, few])
    order = np.lexsort((key, own))
    key, own = key[order], own[order]
    if len(key):
        new = np.append(True, (key[1:] != key[:-1]) | (own[1:] != own[:-1]))
        key, own = key[new], own[new]
    return key, np.searchsorted(own, np.arange(len(at)))


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = T.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(T.BYTE_BASE))
    return base[:n] | np.uint64(1), base[n:]


def signature(keys: np.ndarray, place: np.ndarray, hashes: int) -> np.ndarray:
    """(rows, hashes) minima of multiply-add hashes; rows without n-grams give the largest value."""
    rows = len(place) - 1
    out = np.full((rows, hashes), np.uint32(0xFFFFFFFF), np.uint32)
    some = np.flatnonzero(np.diff(place))
    if len(some):
        at = place[some]
        for n, (a, b) in enumerate(zip(*_factors(hashes))):
            out[some, n] = np.minimum.reduceat(((keys * a + b) >> np.uint64(32)).astype(np.uint32), at)
    return out


SIGNED = pa.schema([("row", pa.int64()), ("set_id", pa.int64()), ("n_grams", pa.int64()), ("sig", pa.binary())])


def signatures(docs: DataFrame, size: int, hashes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in T.runs(batch.column(1)):
                keys, place = ngram_sets(data, at, size)
                n = np.diff(place)
                sig = signature(keys, place, hashes)
                total = np.append(np.uint64(0), np.cumsum(T.mix(keys)))
                # order does not matter in a set, so its members' mixed hashes are summed
                own = T.signed(T.mix((total[place[1:]] - total[place[:-1]]) + n.astype(np.uint64)))
                ids = batch.column(0)[lo:hi]
                yield pa.RecordBatch.from_arrays([ids, pa.array(own, pa.int64(), mask=n == 0), pa.array(n), pa.array([s.tobytes() for s in sig], pa.binary())], schema=SIGNED)

    return docs.mapInArrow(run, "row long, set_id long, n_grams long, sig binary")


def connecting(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of a (rows, columns) 0/1 matrix, as (row, column); columns follow the rows in number."""
    rows, columns = linked.shape
    out, left, free = [], np.ones(rows, bool), np.ones(columns, bool)
    by_row = linked.any(1)
    for start in range(rows):
        if not left[start] or not by_row[start]:
            continue
        left[start], front = False, [start]
        while front:
            r = front.pop()
            for c in np.flatnonzero(linked[r] & free):
                free[c] = False
                out.append((r, int(c)))
                near = np.flatnonzero(linked[:, c] & left)
                left[near] = False
                out += [(int(x), int(c)) for x in near]
                front += near.tolist()
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component of (a, b), by alternating large and small stars.
    Every round is a shuffle of links with a partial minimum; rounds grow with the logarithm of the longest chain."""
    edges = keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links")
    marked = None
    while True:
        # large star: every larger neighbour points at the node's smallest neighbour (or itself)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        # small star: every smaller neighbour, and the node, points at the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").filter("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        now = keep(small.unionByName(least.select("a", F.col("low").alias("b"))).distinct(), "links")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(edges)
        edges = now
        if mark == marked:
            break
        marked = mark
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _in_blocks(rows: DataFrame, group: str, member: str, size: str) -> DataFrame:
    """Rows with the block pairs they take part in: (lo, hi, side); a group of up to BLOCK rows is one block."""
    blocks = F.ceil(F.col(size) / F.lit(BLOCK)).cast("int")
    placed = rows.withColumn("_n", blocks).withColumn("_own", F.pmod(F.xxhash64(member), F.col("_n")).cast("int"))
    return (placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
            .withColumns({"lo": F.least("_own", "_other"), "hi": F.greatest("_own", "_other"), "right": F.col("_own") > F.col("_other")}).drop("_n", "_own", "_other"))


def _sides(lo: int, hi: int, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the two blocks of a block pair; a block compared with itself is both."""
    at = np.arange(len(right))
    return (at, at) if lo == hi else (at[~right], at[right])


LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def families(classes: DataFrame, bands: int, rows: int, floor: float) -> DataFrame:
    """(node, root) of classes that a band and the signatures' agreement connect."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row", pa.int64()), ("band", pa.int64())])
        for batch in batches:
            n = batch.num_rows
            if n:
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, -1).astype(np.uint64)
                key = np.stack([T.Prefix(np.append(sig[:, k * rows:(k + 1) * rows].reshape(-1), 0).astype(np.uint64) + np.uint64(1), T.WORD_BASE)
                                .spans(np.arange(n) * rows, np.arange(1, n + 1) * rows) + np.uint64(k * T.BYTE_BASE % (1 << 64)) for k in range(bands)], 1)
                yield T.batch_of(schema, np.repeat(batch.column(0).to_numpy(), bands), T.signed(key.reshape(-1)))

    banded = classes.select("row", "sig").mapInArrow(cut, "row long, band long")
    shared = banded.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    members = banded.join(shared, "band").join(classes.select("row", "sig"), "row")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in groups(batches, ["band", "lo", "hi"]):
            row, lo, hi = (table.column(c).to_numpy() for c in ("row", "lo", "hi"))
            right = table.column("right").to_numpy()
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(row), -1)
            least = floor * sig.shape[1]
            size = np.diff(edges)
            pair = edges[:-1][(size == 2) & (lo[edges[:-1]] == hi[edges[:-1]])]
            pair = pair[(sig[pair] == sig[pair + 1]).sum(1) >= least]
            a, b = [row[pair]], [row[pair + 1]]
            for start, n in zip(edges[:-1][size > 2].tolist(), size[size > 2].tolist()):
                own = slice(start, start + n)
                left, other = _sides(lo[start], hi[start], right[own])
                agree = np.zeros((len(left), len(other)), np.uint8)
                for k in range(sig.shape[1]):
                    agree += sig[own][left, k][:, None] == sig[own][other, k][None, :]
                for r, c in connecting(agree >= least):
                    a.append(row[own][left[[r]]])
                    b.append(row[own][other[[c]]])
            yield T.batch_of(LINK, np.concatenate(a), np.concatenate(b))

    found = dealt(_in_blocks(members, "band", "row", "size").select("band", "lo", "hi", "right", "row", "sig"), "band", "lo", "hi").mapInArrow(compare, "a long, b long")
    return components(found)


CHECKED = pa.schema([("row", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n_links", pa.int64())])


def shared_grams(raw: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(left, right) sizes of the intersections of n-gram sets, by products of 0/1 columns, some columns at a time."""
    key = np.concatenate(raw)
    own = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    order = np.argsort(key, kind="stable")
    key, own = key[order], own[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    often = np.diff(np.append(first, len(key)))
    held = np.repeat(often > 1, often)                    # n-grams of one document meet nothing
    own, column = own[held], np.repeat(np.arange(np.count_nonzero(often > 1)), often[often > 1])
    total = np.zeros((len(left), len(right)), np.float32)
    columns = int(column[-1]) + 1 if len(column) else 0
    width = min(columns, max(64, CELLS // len(raw)))
    for lo in range(0, columns, max(1, width)):
        a, b = np.searchsorted(column, [lo, lo + width])
        part = np.zeros((len(raw), width), np.float32)
        part[own[a:b], column[a:b] - lo] = 1
        total += part[left] @ part[right].T
    return np.rint(total).astype(np.int64)


def verify(sets: DataFrame, threshold: float) -> DataFrame:
    """Per block pair of a family: counts of linked rows (a, b null) and connecting links (row null)."""
    parts = 1_000_000

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in groups(batches, ["root", "lo", "hi"]):
            row, lo, hi, copies = (table.column(c).to_numpy() for c in ("row", "lo", "hi", "copies"))
            right, grams = table.column("right").to_numpy(), table.column("grams")
            rows, links, a, b = [], [], [], []
            for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
                own = slice(start, end)
                raw = [np.frombuffer(g.as_buffer(), np.uint64) for g in grams[own]]
                size = np.array([len(r) for r in raw])
                left, other = _sides(lo[start], hi[start], right[own])
                if not len(left) or not len(other):
                    continue
                shared = shared_grams(raw, left, other)
                union = size[left][:, None] + size[other][None, :] - shared
                linked = shared * parts >= round(threshold * parts) * union      # integers: exact at the border
                if lo[start] == hi[start]:
                    np.fill_diagonal(linked, False)
                else:
                    rows.append(row[own][other])
                    links.append(linked.T @ copies[own][left])
                rows.append(row[own][left])
                links.append(linked @ copies[own][other])
                found = connecting(linked)
                if found:
                    r, c = np.array(found).T
                    a.append(row[own][left[r]])
                    b.append(row[own][other[c]])
            if rows:
                counted, n = np.concatenate(rows), sum(map(len, a))
                none = pa.nulls(len(counted), pa.int64())
                yield T.batch_of(CHECKED, pa.array(counted), none, none, pa.array(np.concatenate(links)))
                if n:
                    none = pa.nulls(n, pa.int64())
                    yield T.batch_of(CHECKED, none, pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), none)

    return dealt(sets.select("root", "lo", "hi", "right", "row", "copies", "grams"), "root", "lo", "hi").mapInArrow(check, "row long, a long, b long, n_links long")


def to_sets(rows: DataFrame, size: int) -> DataFrame:
    """(row, root, members, copies, grams): the n-gram set in place of the text."""
    schema = pa.schema([("row", pa.int64()), ("root", pa.int64()), ("members", pa.int64()), ("copies", pa.int64()), ("grams", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in T.runs(batch.column(4)):
                keys, place = ngram_sets(data, at, size)
                grams = [keys[a:b].tobytes() for a, b in zip(place[:-1].tolist(), place[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[lo:hi] for c in range(4)), pa.array(grams, pa.binary())], schema=schema)

    return rows.select("row", "root", "members", "copies", "text").mapInArrow(run, "row long, root long, members long, copies long, grams binary")


def near_duplicates(docs: DataFrame, *, size: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """(row, class_id, n_links) of every row of (row long, text): the smallest row of its near-duplicate class and how many
    other rows are linked to it, copies counted one by one."""
    bands, rows = banding(threshold, recall)
    signed = keep(signatures(docs.select("row", "text"), size, bands * rows), "signatures")
    classes = keep(signed.filter("set_id is not null").groupBy("set_id").agg(F.min("row").alias("row"), F.count("*").alias("copies"), F.first("sig").alias("sig")), "classes")
    family = families(classes, bands, rows, max(0.0, threshold - 0.25))
    sized = family.join(family.groupBy("root").agg(F.count("*").alias("members")), "root")
    wanted = sized.withColumnRenamed("node", "row").join(classes.select("row", "copies"), "row")
    texts = docs.select("row", "text").join(wanted, "row")
    sets = _in_blocks(to_sets(texts, size), "root", "row", "members")
    checked = keep(verify(sets, threshold), "verified")
    counts = checked.filter("n_links is not null").groupBy("row").agg(F.sum("n_links").alias("near"))
    roots = components(checked.filter("a is not null").select("a", "b"))
    found = (classes.select("set_id", "row", "copies").join(counts, "row", "left").join(roots.withColumnRenamed("node", "row"), "row", "left")
             .select("set_id", F.coalesce("root", "row").alias("class_id"), (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    return (signed.select("row", "set_id").join(found, "set_id", "left")
            .select("row", F.coalesce("class_id", "row").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))


def named(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, bool]:
    """``docs`` with ``row``: the id where ids are unique and not null, else a hash of all columns."""
    if not docs.filter(F.col(key).isNull()).take(1) and not docs.groupBy(key).count().filter("count > 1").take(1):
        return docs.withColumn("row", F.col(key).cast("long")), True
    return docs.withColumn("row", F.xxhash64(*(F.col(c).cast("string") for c in docs.columns))), False


def document_classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (smallest id of the class), n_links of every row. Rows equal in every column are one document."""
    rows, plain = named(docs.select("doc_id", "text"))
    if plain:
        return near_duplicates(rows, **options).withColumnRenamed("row", "doc_id")
    found = rows.select("row", "doc_id").join(near_duplicates(rows.dropDuplicates(["row"]), **options), "row")
    least = found.groupBy("class_id").agg(F.min("doc_id").alias("least"))
    return found.join(least, "class_id").select("doc_id", F.col("least").alias("class_id"), "n_links")


def first_of_class(docs: DataFrame, **options) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest id, columns unchanged."""
    names = docs.columns
    key, text = (f"_c{names.index(c)}" for c in ("doc_id", "text"))
    rows, plain = named(docs.withColumnsRenamed({c: f"_c{n}" for n, c in enumerate(names)}), key)
    if not plain:
        rows = rows.dropDuplicates(["row"])
    found = near_duplicates(rows.select("row", F.col(text).alias("text")), **options)
    if plain:
        kept = found.filter("row = class_id").select("row")
    else:
        order = F.struct(F.col(key).isNull(), F.col(key), F.col("row"))
        kept = rows.select("row", order.alias("_order")).join(found, "row").groupBy("class_id").agg(F.min_by("row", "_order").alias("row")).select("row")
    return rows.join(kept, "row", "left_semi").select(*(F.col(f"_c{n}").alias(c) for n, c in enumerate(names)))


def brute_force(texts: list[tuple[int, str | None]], size: int = 5, threshold: float = 0.8) -> dict[int, tuple[int, int]]:
    """{row: (class, links)} by comparing all pairs, for tests."""
    import re
    grams = {}
    for row, text in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        grams[row] = {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    parent = {row: row for row in grams}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    links = dict.fromkeys(grams, 0)
    rows = sorted(grams)
    for i, a in enumerate(rows):
        for b in rows[i + 1:]:
            union = len(grams[a] | grams[b])
            if grams[a] and grams[b] and len(grams[a] & grams[b]) >= threshold * union - 1e-9:
                links[a] += 1
                links[b] += 1
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return {row: (find(row), links[row]) for row in rows}
