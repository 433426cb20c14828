"""Sharding by a hierarchical weighted hash tree, with built-in functions only.

A layout is a tree of regions, racks and shards with weights. A document descends it: on every level each child draws
-ln(u) / weight, with u a hash of the key and the child, and the smallest draw wins. A child's weight enters its own
draw alone, so a change of weights moves rows only into subtrees that grew or out of subtrees that shrank: a shard added
to a rack draws rows into its rack and region, and rows that newly reach them are dealt among all their shards. ``grow``
makes the added shard a region of its own, at the root; then rows move into that shard and nowhere else.

The tree is a literal of the plan (one entry per inner node); placing a row is a projection, without a shuffle. Slots
are running counts in two steps, over buckets of a hash first and inside a bucket then, so that no shard is sorted by
one task; equal rows are counted before they are dealt, and get consecutive slots.

Cases: a null id is a key of its own; a null text has 0 bytes and checksum 0; repeated rows get slots of their own; an empty table
gives no rows; ``place`` keeps the columns of the input and adds region, rack and shard (existing ones of these names are an
error, as two columns of one name would be); a child of weight 0 takes nothing.
"""
from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_DIGITS = 3       # hex digits: 4,096 buckets a shard
RUN = 4096              # equal rows written out at a time
ROOT = "/"

Layout = list[tuple[int, int, int, float]]


def layout(regions: int = 2, racks: int = 2, shards: int = 2) -> Layout:
    """(region, rack, shard, weight) of an even tree; racks and shards are numbered through."""
    return [(n // (racks * shards), n // shards, n, 1.0) for n in range(regions * racks * shards)]


def grow(own: Layout, weight: float = 1.0) -> Layout:
    """One more shard in a region of its own: it takes rows only into itself."""
    return own + [(max(r for r, *_ in own) + 1, max(k for _, k, *_ in own) + 1, max(s for *_, s, _ in own) + 1, weight)]


def children(own: Layout) -> dict[str, list[tuple[str, float]]]:
    """Names and weights of the children of every inner node; a name is the path to the node."""
    weights: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    for region, rack, shard, weight in own:
        names = [ROOT, f"/{region}", f"/{region}/{rack}", f"/{region}/{rack}/{shard}"]
        for up, down in zip(names, names[1:]):
            weights[up][down] += weight
    return {up: [(name, w) for name, w in below.items() if w > 0] for up, below in weights.items()}


def _draw(key: Column, child: Column) -> Column:
    """-ln(u) / weight, with u in (0, 1] from 52 bits of a hash of the key and the child's name."""
    bits = F.conv(F.substring(F.md5(F.concat(key, child["name"]).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 1) / F.lit(float(1 << 52))) / child["weight"]


def leaf(key: Column, own: Layout) -> Column:
    """The path of the shard in which a key ends."""
    tree = F.create_map(*(x for up, below in children(own).items()
                          for x in (F.lit(up), F.array(*(F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight")) for n, w in below)))))
    node: Column = F.lit(ROOT)
    for _ in range(3):
        node = F.array_min(F.transform(F.element_at(tree, node), lambda c: F.struct(_draw(key, c).alias("draw"), c["name"].alias("name"))))["name"]
    return node


def key_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def place(docs: DataFrame, own: Layout | None = None, *, key: str = "doc_id") -> DataFrame:
    """``docs`` with region, rack and shard. One projection; nothing is shuffled."""
    clash = {"region", "rack", "shard"} & set(docs.columns)
    if clash:
        raise ValueError(f"the input already has {sorted(clash)}")
    steps = F.split(F.col("_leaf"), "/")
    return (docs.withColumn("_leaf", leaf(key_of(key), own or layout()))
            .withColumns({name: F.element_at(steps, n + 2).cast("int") for n, name in enumerate(("region", "rack", "shard"))}).drop("_leaf"))


def write(docs: DataFrame, path: str, own: Layout | None = None, *, key: str = "doc_id") -> None:
    """The documents as Parquet, one folder per shard; every task writes its own file into it."""
    place(docs, own, key=key).drop("region", "rack").write.partitionBy("shard").parquet(path)


def slots(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, columns, slot): equal rows counted and written out again with gapless places in their group, ordered by a hash of the columns."""
    text = F.concat_ws(":", *(key_of(c) for c in columns))
    counted = rows.groupBy(group, *columns).agg(F.count("*").alias("_n")).withColumn("_hash", F.md5(text.cast("binary")))
    counted = counted.withColumn("_bucket", F.substring("_hash", 1, BUCKET_DIGITS))
    sums = counted.groupBy(group, "_bucket").agg(F.sum("_n").alias("_sum"))
    ahead = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = sums.select(group, "_bucket", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_head"))
    inside = Window.partitionBy(group, "_bucket").orderBy("_hash", *columns).rowsBetween(Window.unboundedPreceding, -1)
    begun = counted.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(heads, [group, "_bucket"])
    start = begun.select(group, *columns, "_n", (F.col("_head") + F.col("_in")).alias("_at"))
    runs = start.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(RUN).cast("long"))))
    return runs.select(group, *columns, F.explode(F.sequence(F.col("_at") + F.col("_run"), F.col("_at") + F.least(F.col("_run") + RUN, F.col("_n")) - 1)).alias("slot"))


def shards(docs: DataFrame, own: Layout | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document; the texts are read once and never shuffled."""
    own = own or layout()
    text = F.coalesce("text", F.lit("")).cast("binary")
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = slots(place(sized, own).drop("region", "rack"), "shard", ["doc_id", "size", "text_crc32"])
    grown = F.element_at(F.split(leaf(key_of("doc_id"), grow(own)), "/"), -1).cast("int")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", grown.alias("grown_shard"))
