"""Which positions of a window are hidden. Windows are short, so windowed ranks stay small."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw_hex, draw_int, uniform

SEEDED = ("random", "block")


def hidden_count(kind: str, ratio: float, length: int, keep_endpoints: bool = True) -> int:
    """Number of hidden positions (or the step of keep_every); rounding is half-to-even."""
    if kind == "keep_every":
        if int(ratio) < 2:
            raise ValueError("keep_every needs a step of at least 2")
        return int(ratio)
    if kind == "last":
        k = int(ratio) if ratio >= 1 else round(ratio * length)
        return min(max(k, 1), length - 2)
    if kind not in SEEDED:
        raise ValueError("kind must be 'random', 'block', 'last' or 'keep_every'")
    avail = length - 2 if keep_endpoints else length
    return min(max(round(ratio * length), 1), avail)


def recovery_runs(kinds, ratios, seeds, schemes=()) -> list[tuple[str, float, int, str]]:
    """(kind, ratio, seed, task): seeds vary the drawn masks only; fixed schemes are scored once."""
    named = [(k, r, f"recovery/{k}@{r:g}") for k in kinds for r in ratios]
    named += [(k, r, f"recovery/{k}:{r:g}") for k, r in schemes]
    return [(k, r, s, task) for k, r, task in named for s in (seeds if k in SEEDED else seeds[:1])]


def with_masks(windows: DataFrame, runs: list[tuple[str, float, int, str]], length: int,
               keep_endpoints: bool = True) -> DataFrame:
    """Every window once per run, with ``task``, ``kind``, ``eval_seed`` and ``hidden``.

    The runs are a literal array, so all masks come out of one pass and one exchange.
    """
    lo, hi = (1, length - 1) if keep_endpoints else (0, length)
    entries = F.array(*[F.struct(F.lit(task).alias("task"), F.lit(kind).alias("kind"), F.lit(seed).alias("eval_seed"),
                                 F.lit(hidden_count(kind, ratio, length, keep_endpoints)).alias("k"))
                        for kind, ratio, seed, task in runs])
    rows = windows.withColumn("_r", F.explode(entries)).select(*windows.columns, "_r.*")
    inside = (F.col("pos") >= lo) & (F.col("pos") < hi)
    order = F.when(inside, draw_hex(F.col("eval_seed"), "mask", F.col("window_id"), F.col("pos")))
    w = Window.partitionBy("task", "eval_seed", "window_id").orderBy(F.asc_nulls_last("_h"), "pos")
    rows = rows.withColumn("_h", F.when(F.col("kind") == "random", order))
    start = lo + F.pmod(draw_int(F.col("eval_seed"), "block", F.col("window_id")), F.lit(hi - lo + 1) - F.col("k"))
    rule = F.when(F.col("kind") == "random", inside & (F.row_number().over(w) <= F.col("k"))) \
        .when(F.col("kind") == "block", (F.col("pos") >= start) & (F.col("pos") < start + F.col("k"))) \
        .when(F.col("kind") == "last", F.col("pos") >= length - F.col("k")) \
        .otherwise((F.col("pos") % F.col("k") != 0) & (F.col("pos") != length - 1))
    return rows.withColumn("hidden", rule).drop("_h", "k")


def block_ends(masked: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``is_end``: last position of each hidden run."""
    after = F.lead("hidden").over(Window.partitionBy(*keys).orderBy("pos"))
    return masked.withColumn("is_end", F.col("hidden") & ~F.coalesce(after, F.lit(False)))


# Share of each masking strategy.
STRATEGY_MIX = (("random", 0.70), ("rdp", 0.15), ("block", 0.05), ("last_n", 0.10))


def mask_strategy_mix(windows: DataFrame, keypoints: DataFrame, length: int, ratio: float, seed: int = 0,
                      mask_endpoints: bool = True) -> DataFrame:
    """One drawn strategy per window: random, key points, a block of 5-14 or the last 3-7, each filled
    up to ``int(ratio * length)`` in seeded order. ``keypoints``: (window_id, pos, key)."""
    lo, hi = (0, length) if mask_endpoints else (1, length - 1)
    allowed = (F.col("pos") >= lo) & (F.col("pos") < hi)
    num = min(int(length * ratio), hi - lo)
    wid = F.col("window_id")
    pick, edge, strategy = uniform(seed, "strategy", wid), 0.0, F
    for name, share in STRATEGY_MIX[:-1]:
        edge += share
        strategy = strategy.when(pick < edge, name)
    strategy = strategy.otherwise(STRATEGY_MIX[-1][0])
    rows = windows.join(keypoints.select("window_id", "pos", "key"), ["window_id", "pos"]).withColumn("strategy", strategy)
    size = F.least(5 + F.pmod(draw_int(seed, "size", wid), F.lit(10)), F.lit(max(1, hi - lo)))
    start = lo + F.pmod(draw_int(seed, "start", wid), F.greatest(hi - lo - size, F.lit(0)) + 1)
    tail = 3 + F.pmod(draw_int(seed, "tail", wid), F.lit(5))
    core = F.when(F.col("strategy") == "rdp", F.col("key") & (F.col("pos") > 0) & (F.col("pos") < length - 1)) \
        .when(F.col("strategy") == "block", (F.col("pos") >= start) & (F.col("pos") < start + size)) \
        .when(F.col("strategy") == "last_n", (F.col("pos") >= hi - tail) & (F.col("pos") < hi)) \
        .otherwise(F.lit(False)) & allowed
    w = Window.partitionBy("window_id")
    rows = rows.withColumns({"_core": core, "_ok": allowed, "_h": draw_hex(seed, "fill", wid, F.col("pos"))})
    rows = rows.withColumn("_corerank", F.row_number().over(w.orderBy((~F.col("_core")).cast("int"), "_h")))
    # key points beyond the budget are drawn; blocks and tails keep their full length
    rows = rows.withColumn("_core", F.col("_core") & ((F.col("strategy") != "rdp") | (F.col("_corerank") <= num)))
    rows = rows.withColumn("_have", F.sum(F.col("_core").cast("int")).over(w))
    free = (F.col("_ok") & ~F.col("_core")).cast("int")
    rows = rows.withColumn("_fill", F.row_number().over(w.orderBy((1 - free), "_h")))
    hidden = F.col("_core") | ((free == 1) & (F.col("_fill") <= num - F.col("_have")))
    return rows.withColumn("hidden", hidden).select(*windows.columns, "strategy", "hidden")


def mask_spans(windows: DataFrame, length: int, seed: int = 0, cut_share: float = 0.2, hide_share: float = 0.4,
               feature_p: float = 0.2, one_span: bool = False) -> DataFrame:
    """Whole spans hidden in both modalities, then one modality of single points with ``feature_p``.

    Spans lie between drawn cut positions; ``one_span`` hides a single drawn interval instead.
    """
    wid, pos = F.col("window_id"), F.col("pos")
    w = Window.partitionBy("window_id")
    if one_span:
        a, b = F.pmod(draw_int(seed, "s", wid), F.lit(length)), F.pmod(draw_int(seed, "e", wid), F.lit(length))
        rows = windows.withColumn("span_hidden", (pos >= F.least(a, b)) & (pos <= F.greatest(a, b)))
    else:
        n_cuts = math.ceil(length * cut_share)
        rows = windows.withColumn("_h", draw_hex(seed, "cut", wid, pos))
        cut = (F.row_number().over(w.orderBy("_h")) <= n_cuts) & (pos > 0)
        rows = rows.withColumn("_cut", cut.cast("int"))
        rows = rows.withColumn("_span", F.sum("_cut").over(w.orderBy("pos")))
        rows = rows.withColumns({"_spans": F.sum("_cut").over(w) + 1, "_sh": draw_hex(seed, "span", wid, F.col("_span"))})
        rank = F.dense_rank().over(w.orderBy("_sh"))
        rows = rows.withColumn("span_hidden", rank <= F.ceil(F.col("_spans") * hide_share)) \
            .drop("_h", "_cut", "_span", "_spans", "_sh")
    picked = uniform(seed, "feature", wid, pos) < feature_p
    spatial = uniform(seed, "which", wid, pos) < 0.5
    return rows.withColumns({"hidden_spatial": F.col("span_hidden") | (picked & spatial),
                             "hidden_temporal": F.col("span_hidden") | (picked & ~spatial)})
