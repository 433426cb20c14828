"""Ordered (window) work on groups of any size.

A window over ``(user, t)`` is one exchange for a whole chain of lags, sums and numbers, but it sends
each user to one task; a user that holds a third of all rows would then be the run time of the job.
``over_groups`` therefore measures the groups first. Groups of ordinary size take the plain windows.
Larger ones are cut into chunks along their own order (a day of fixes, a range partition): the window
runs inside ``(group, chunk)``, and what crosses a border - the last row, the count, the sum so far -
travels in a table with one row per chunk. Both ways give the same rows.
"""
from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, partitions

CHUNK = "_chunk"
DAY = 86_400
HOT_SETTING, HOT_ROWS = "wayspark.hotGroupRows", 1_000_000


def by_day(t: str = "t", seconds: int = DAY) -> Column:
    return F.floor(F.col(t) / seconds)


def hot_groups(df: DataFrame, keys: list[str]) -> DataFrame | None:
    """Keys of groups above the row limit (at most rows / limit of them), or None without any. Counts
    combine map-side and read the key columns only."""
    limit = int(df.sparkSession.conf.get(HOT_SETTING, str(HOT_ROWS)))
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select(*keys)
    return cut_lineage(hot) if hot.take(1) else None


def over_groups(*keys: str, chunk: Callable[[], Column]):
    """Runs ``fn(df, ..., chunk=None)`` on ordinary groups and ``fn(df, ..., chunk=chunk())`` on the
    hot ones. A caller that has measured already passes ``chunk`` itself."""
    def wrap(fn):
        @functools.wraps(fn)
        def call(df: DataFrame, *args, **kwargs):
            if "chunk" in kwargs:
                return fn(df, *args, **kwargs)
            hot = hot_groups(df, list(keys))
            if hot is None:
                return fn(df, *args, chunk=None, **kwargs)
            usual = fn(df.join(hot, list(keys), "left_anti"), *args, chunk=None, **kwargs)
            large = fn(df.join(hot, list(keys), "left_semi"), *args, chunk=chunk(), **kwargs)
            return usual.unionByName(large)
        return call
    return wrap


def range_chunks(df: DataFrame, order: list[str], n: int | None = None) -> DataFrame:
    """Chunk by range partition of ``order``. Written out before use, so that both readers of the
    result see the same borders; for orders with no natural step such as scores or start times."""
    n = n or partitions(df.sparkSession)
    placed = df.repartitionByRange(n, *order).withColumn(CHUNK, F.spark_partition_id().cast("bigint"))
    return cut_lineage(placed)


def _chunked(df: DataFrame, chunk: Column | None) -> DataFrame:
    """Chunked input is written once, as the window and the border table both read it."""
    return df if chunk is None else cut_lineage(df.withColumn(CHUNK, chunk))


def _plain(df: DataFrame, chunk: Column | None) -> bool:
    return chunk is None and CHUNK not in df.columns


def _inside(keys, order):
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def _join_carry(local: DataFrame, carry: DataFrame, keys) -> DataFrame:
    return local.join(carry, [*keys, CHUNK], "left")


def _struct(columns):
    return F.struct(*[F.col(c) for c in columns])


def neighbour(df: DataFrame, keys: list[str], order: list[str], columns: list[str], prefix: str = "prev_",
              chunk: Column | None = None, ahead: bool = False, keep_chunk: bool = False) -> DataFrame:
    """``lag`` (or ``lead`` with ``ahead``) of ``columns``, as ``<prefix><column>``."""
    pick = F.lead if ahead else F.lag
    if _plain(df, chunk):
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({prefix + c: pick(c).over(w) for c in columns})
    work = _chunked(df, chunk)
    edge = F.min_by if ahead else F.max_by
    edges = work.groupBy(*keys, CHUNK).agg(edge(_struct(columns), _struct(order)).alias("_edge"))
    over_chunks = Window.partitionBy(*keys).orderBy(CHUNK)
    carry = edges.select(*keys, CHUNK, pick("_edge").over(over_chunks).alias("_carry")).filter("_carry is not null")
    local = work.withColumn("_near", pick(_struct(columns)).over(_inside(keys, order)))
    out = _join_carry(local, carry, keys).withColumn("_near", F.coalesce("_near", "_carry"))
    for c in columns:
        out = out.withColumn(prefix + c, F.col("_near")[c])
    return out.drop("_near", "_carry", *([] if keep_chunk else [CHUNK]))


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column],
            chunk: Column | None = None, keep_chunk: bool = False) -> DataFrame:
    """Inclusive cumulative sums in ``order``."""
    if _plain(df, chunk):
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({name: F.sum(value).over(w) for name, value in sums.items()})
    work = _chunked(df, chunk)
    for name, value in sums.items():
        work = work.withColumn(f"_v_{name}", value)
    totals = work.groupBy(*keys, CHUNK).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, CHUNK, *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in sums])
    upto = _inside(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = work
    for name in sums:
        local = local.withColumn(name, F.sum(f"_v_{name}").over(upto))
    out = _join_carry(local, carry, keys)
    for name in sums:
        out = out.withColumn(name, F.col(name) + F.coalesce(F.col(f"_c_{name}"), F.lit(0)))
    return out.drop(*[f"_{p}_{n}" for n in sums for p in "vc"], *([] if keep_chunk else [CHUNK]))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "rn",
             chunk: Column | None = None) -> DataFrame:
    """1-based position of every row in its group."""
    return running(df, keys, order, {name: F.lit(1).cast("bigint")}, chunk)


def last_known(df: DataFrame, keys: list[str], order: list[str], column: str, name: str,
               chunk: Column | None = None) -> DataFrame:
    """Latest non-null ``column`` at or before each row: the as-of fill."""
    if _plain(df, chunk):
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(name, F.last(column, ignorenulls=True).over(w))
    work = _chunked(df, chunk)
    known = work.filter(F.col(column).isNotNull())
    edges = known.groupBy(*keys, CHUNK).agg(F.max_by(F.col(column), _struct(order)).alias("_edge"))
    frame = work.select(*keys, CHUNK).distinct().join(edges, [*keys, CHUNK], "left")
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = frame.select(*keys, CHUNK, F.last("_edge", ignorenulls=True).over(before).alias("_carry"))
    upto = _inside(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = work.withColumn(name, F.last(column, ignorenulls=True).over(upto))
    out = _join_carry(local, carry, keys).withColumn(name, F.coalesce(name, "_carry"))
    return out.drop("_carry", CHUNK)


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """1-based rank over the whole table without a single-task window."""
    one = df.withColumn("_all", F.lit(0))
    return numbered(range_chunks(one, order), ["_all"], order, name).drop("_all")


def group_size(df: DataFrame, keys: list[str], name: str, chunk: Column | None) -> DataFrame:
    """Adds the number of rows of the group."""
    if _plain(df, chunk):
        return df.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return df.join(sizes, keys)


def row_blocks(df: DataFrame, keys: list[str], index: str, size: int, before: int = 0) -> DataFrame:
    """Blocks of ``size`` consecutive rows (0-based ``index``) with a halo of ``before`` earlier rows.

    Adds ``_block`` and ``_own``; a rows-frame of up to ``before`` preceding rows computed inside
    ``(keys, _block)`` is exact for the rows with ``_own``, and no block exceeds size + before rows.
    """
    home = F.floor(F.col(index) / size)
    ahead = F.floor((F.col(index) + before) / size)
    spread = df.withColumn("_block", F.explode(F.sequence(home, ahead)))
    return spread.withColumn("_own", F.col("_block") == home)


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated percentiles of unbounded groups.

    The built-in exact ``percentile`` keeps all distinct values of a group in one task. Here values
    are counted first, ranked by range chunks, and only the two order statistics around each
    requested rank are kept.
    """
    groups = keys or ["_all"]
    base = df if keys else df.withColumn("_all", F.lit(0))
    counts = base.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    chunks = range_chunks(counts, [*groups, value])
    sizes = chunks.groupBy(*groups).agg(F.sum("_n").alias("_size"))
    joined = running(chunks, groups, [value], {"_upto": F.col("_n")}).join(sizes, groups)
    holds = lambda r: (F.col("_upto") >= r) & (F.col("_upto") - F.col("_n") < r)
    aggregates = []
    for name, p in probs.items():
        h = F.lit(float(p)) * (F.col("_size") - 1)
        lo = F.max(F.when(holds(F.floor(h) + 1), F.col(value)))
        hi = F.max(F.when(holds(F.ceil(h) + 1), F.col(value)))
        aggregates.append((lo + (hi - lo) * F.max(h - F.floor(h))).alias(name))
    return joined.groupBy(*groups).agg(*aggregates).select(*keys, *probs)
