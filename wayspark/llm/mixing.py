"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

1. Targets: each source's share of the mix by weight, at most ``most`` times its size; what is above is shared again by
   weight until no source is above. That is one water level, found from the sources sorted by size over weight.
2. Blocks: a source's documents are laid end to end in the order of a hash (the shuffle), and cut every ``block`` words. A
   block may begin inside a document.
3. Schedule: point t of the golden-ratio sequence, t * K modulo 2^31 with an odd K next to 2^31 / 1.618, falls into one source's part of the cumulative
   weights, so each stretch of the schedule holds the sources in proportion; whole numbers keep that exact for any t. A source's slots are ranked in the order of t; slot r takes
   block r modulo the number of blocks, and the last slot takes what is left of the target. Slots beyond a source's
   target are passed over; a source that the finite sequence left short gets its last slots at the end.
4. A document is taken by the slots whose words reach into it: ``first_slot`` is the first place in the schedule that does,
   ``n_slots`` counts them.

Ranks and offsets are running totals in two steps: totals of hash buckets (or of stretches of the schedule) first,
and then inside a bucket, so that no source, however large, is sorted by one task. Number of words of a whole text:
``[^\\x20\\x09-\\x0D]+``. The rows of the source table (one per source) pass through one window; texts never do.

Cases: a null text has 0 words and takes 0, in no slot (``first_slot`` null); a source without words has target 0; a null source is a source of its own
and comes last; ties of the hash are ordered by the id and by all columns' hash; repeated rows are documents of their own; an
empty table gives no rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import keep

WEIGHTS = (3, 1, 2)
# fixed values: the period of the sequence and the odd number next to its golden section
PERIOD, GOLDEN = 1 << 31, 1_327_217_885
STRETCH = 1 << 16


def n_words(text: Column) -> Column:
    """A word starts at a character that is no space behind one that is: counted without cutting the text."""
    spaced = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.when(spaced == "", F.lit(0)).otherwise(F.regexp_count(spaced, F.lit(" +")) + 1).cast("long")


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), one row per source."""
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    in_order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int"))
    marked = sizes.withColumn("weight", weight).withColumns({
        "cap": F.col("source_size") * F.lit(most), "ratio": F.col("source_size") * F.lit(most) / F.col("weight"), "total": F.sum("source_size").over(every) * F.lit(share)})
    # sources in the order of cap over weight: the first ones are full, and the level of the rest is what remains by weight
    before = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    water = marked.withColumn("level", level).withColumn("full", F.col("ratio") <= F.col("level"))
    final = F.min(F.when(~F.col("full"), F.struct("ratio", "level"))).over(every)["level"]
    return water.withColumn("target", F.when(F.col("full") | final.isNull(), F.col("cap")).otherwise(final * F.col("weight"))).select("source", "source_size", "weight", "target")


def running(rows: DataFrame, group: str, bucket: str, order: list, value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` before the row in its group, in the order of bucket and then ``order``."""
    sums = rows.groupBy(group, bucket).agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    heads = sums.withColumn("_head", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).drop("_sum").withColumnsRenamed({group: "_g", bucket: "_b"})
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .join(heads, F.col(group).eqNullSafe(F.col("_g")) & (F.col(bucket) == F.col("_b"))).withColumn(name, F.col("_head") + F.col("_in")).drop("_g", "_b", "_head", "_in"))


CELLS = 4096
SMALL = 100_000        # rows of the source table that may be broadcast


def small(df: DataFrame, rows: int) -> DataFrame:
    """A hint where the source table has a checked, small number of rows; else a plain join."""
    return F.broadcast(df) if rows <= SMALL else df


def schedule(plan: DataFrame, sources: int) -> DataFrame:
    """(number, slot, t): each source's ``slots`` in the order of time; t is the place in the whole schedule."""
    spark = plan.sparkSession
    slots = plan.filter("slots > 0").select("number", "slots")
    total = int(slots.agg(F.sum("slots")).first()[0] or 0)
    share = lambda upto: F.call_function("div", upto.cast("decimal(20,0)") * F.lit(PERIOD).cast("decimal(11,0)"), F.lit(max(1, total)).cast("decimal(20,0)"))
    to = F.sum("slots").over(Window.orderBy("number"))
    parts = slots.withColumns({"from": share(to - F.col("slots")), "to": share(to)})
    # a source lies in the cells that its part of the line touches: at most CELLS rows more than sources
    wide = PERIOD // CELLS
    cell = lambda c: F.floor(c / wide)
    cells = parts.filter(F.col("to") > F.col("from")).withColumn("cell", F.explode(F.sequence(cell(F.col("from")), cell(F.col("to") - 1))))
    points = spark.range(total).withColumnRenamed("id", "t").withColumn("u", (F.col("t") % PERIOD) * GOLDEN % PERIOD).withColumn("cell", cell(F.col("u")))
    placed = points.join(small(cells, sources), "cell").filter((F.col("u") >= F.col("from")) & (F.col("u") < F.col("to")))
    stretch = placed.select("t", "number", "slots", F.floor(F.col("t") / F.lit(STRETCH)).alias("stretch"), F.lit(1).alias("one"))
    ranked = running(stretch, "number", "stretch", ["t"], "one", "slot").filter("slot < slots").select("number", "slot", "t")
    given = ranked.groupBy("number").agg(F.count("*").alias("given"))
    short = slots.join(given, "number", "left").withColumn("given", F.coalesce("given", F.lit(0))).filter("given < slots")
    late = short.select("number", F.explode(F.sequence(F.col("given"), F.col("slots") - 1)).alias("slot"))
    return ranked.unionByName(late.withColumn("t", F.lit(total) + F.col("slot")))


def planned(sizes: DataFrame, block: int, **options) -> DataFrame:
    """The source table: number, target in whole words, blocks and slots."""
    S, B, W = F.col("source_size"), F.lit(block), F.col("words")
    turns = F.when(S > 0, F.floor(W / S)).otherwise(0)
    return (targets(sizes, **options)
            .withColumn("number", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))))
            .withColumn("words", F.floor(F.col("target") + F.lit(0.5)).cast("long"))
            .withColumn("blocks", F.ceil(S / B))
            .withColumn("slots", (turns * F.col("blocks") + F.ceil((W - turns * S) / B)).cast("long")))


def takes(plan: DataFrame, sources: int, block: int) -> DataFrame:
    """(number, slot, t, block, room): the schedule's slots with their blocks and the words that each takes of its block, from the start."""
    slots = schedule(plan, sources).join(small(plan.select("number", "blocks", "source_size", "words"), sources), "number")
    turn, at = F.floor(F.col("slot") / F.col("blocks")), (F.col("slot") % F.col("blocks")).cast("long")
    left = F.col("words") - turn * F.col("source_size") - at * F.lit(block)
    return slots.select("number", "slot", "t", at.alias("block"), F.greatest(F.lit(0), F.least(F.lit(block), F.col("source_size") - at * F.lit(block), left)).alias("room"))


def mix(docs: DataFrame, *, block: int = 1024, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot, n_slots of every document: the words that the schedule takes of it, repeats counted,
    where it first does, and how often."""
    own = keep(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("_tie")), "sizes")      # texts are read once
    sizes = own.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = keep(planned(sizes, block, **options), "sources")
    sources = plan.count()
    shuffled = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    of = plan.select(F.col("source").alias("_source"), "source_size", "target", "number")
    rows = (own.join(small(of, sources), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
            .withColumn("_key", shuffled).withColumn("_bucket", F.substring("_key", 1, 3)))
    empty = rows.filter("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"),
                                           F.lit(None).cast("long").alias("first_slot"), F.lit(0).cast("long").alias("n_slots"))
    placed = running(rows.filter("size > 0"), "number", "_bucket", ["_key", "doc_id", "_tie"], "size", "start")
    first, last = F.floor(F.col("start") / F.lit(block)), F.floor((F.col("start") + F.col("size") - 1) / F.lit(block))
    touched = placed.select("doc_id", "size", "source_size", "target", "number", "start", F.explode(F.sequence(first, last)).alias("block"))
    rooms = takes(plan, sources, block).groupBy("number", "block").agg(F.collect_list(F.struct("t", "room")).alias("rooms"))    # at most ``most`` of them
    begin = F.greatest(F.col("start") - F.col("block") * F.lit(block), F.lit(0))
    end = F.least(F.col("start") + F.col("size") - F.col("block") * F.lit(block), F.lit(block))
    held = F.filter("rooms", lambda r: r["room"] > begin)
    words = F.aggregate(F.coalesce("held", F.array().cast("array<struct<t:bigint,room:bigint>>")), F.lit(0).cast("bigint"), lambda sum_, r: sum_ + (F.least(end, r["room"]) - begin).cast("bigint"))
    # a document with words is the only one of its source that starts where it does
    joined = touched.join(rooms, ["number", "block"], "left").withColumn("held", held).withColumns({"words": words, "at": F.array_min("held.t"), "times": F.coalesce(F.size("held"), F.lit(0))})
    found = joined.groupBy("number", "start").agg(*(F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")), F.sum("words").alias("taken"),
                                                  F.min("at").alias("first_slot"), F.sum(F.greatest("times", F.lit(0))).cast("long").alias("n_slots"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots").unionByName(empty)


SQL = """
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0b\f\r]+')) AS BIGINT) AS size FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS number FROM sized GROUP BY source),
marked AS (SELECT *, CAST(CASE (number - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight FROM sizes),
capped AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio, (SELECT CAST(sum(source_size) AS DOUBLE) * 1.5 FROM sizes) AS total FROM marked),
levels AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                  / sum(weight) OVER (ORDER BY ratio, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM capped),
water AS (SELECT min_by(level, ratio) AS level FROM levels WHERE ratio > level),
plan AS (SELECT source, source_size, number, CASE WHEN l.ratio <= l.level OR w.level IS NULL THEN cap ELSE w.level * weight END AS target FROM levels l CROSS JOIN water w),
blocks AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS words, (source_size + 1023) // 1024 AS blocks FROM plan),
slotted AS (SELECT *, CASE WHEN source_size > 0 THEN (words // source_size) * blocks + (words % source_size + 1023) // 1024 ELSE 0 END AS slots FROM blocks),
parts AS (SELECT number, slots, (CAST(sum(slots) OVER (ORDER BY number) - slots AS HUGEINT) * 2147483648) // (SELECT sum(slots) FROM slotted) AS lo, (CAST(sum(slots) OVER (ORDER BY number) AS HUGEINT) * 2147483648) // (SELECT sum(slots) FROM slotted) AS hi
          FROM slotted WHERE slots > 0),
points AS (SELECT t, (t % 2147483648) * 1327217885 % 2147483648 AS u FROM range(0, (SELECT CAST(sum(slots) AS BIGINT) FROM slotted)) r(t)),
ranked AS (SELECT number, slots, t, row_number() OVER (PARTITION BY number ORDER BY t) - 1 AS slot FROM points JOIN parts ON u >= lo AND u < hi),
given AS (SELECT number, slot, t FROM ranked WHERE slot < slots),
late AS (SELECT p.number, s.slot, (SELECT CAST(sum(slots) AS BIGINT) FROM slotted) + s.slot AS t FROM parts p, range(0, (SELECT CAST(max(slots) AS BIGINT) FROM parts)) s(slot)
         WHERE s.slot < p.slots AND s.slot >= (SELECT count(*) FROM given g WHERE g.number = p.number)),
taking AS (SELECT a.number, a.t, (a.slot % b.blocks) * 1024 AS lo, least((a.slot % b.blocks) * 1024 + 1024, b.source_size, b.words - (a.slot // b.blocks) * b.source_size) AS hi
           FROM (SELECT * FROM given UNION ALL SELECT * FROM late) a JOIN slotted b USING (number)),
placed AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.number,
                  CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(CAST(d.doc_id AS VARCHAR)), d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
           FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)
SELECT d.doc_id, any_value(d.size) AS size, any_value(d.source_size) AS source_size, any_value(d.target) AS target,
       CAST(coalesce(sum(least(t.hi, d.start + d.size) - greatest(t.lo, d.start)) FILTER (t.t IS NOT NULL), 0) AS BIGINT) AS taken, min(t.t) AS first_slot, count(t.t) AS n_slots
FROM placed d LEFT JOIN taking t ON t.number = d.number AND t.lo < d.start + d.size AND t.hi > d.start GROUP BY d.doc_id
"""
