"""Injected anomalies: corrupted copies of evaluation windows with known labels.

Timestamps never change. All kinds and seeds come out of one pass: the runs are exploded from a
literal array, and windows are short, so their ordered sums stay inside one small group each.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import union_all
from ..functions.draws import draw_hex, draw_int, normal, uniform
from ..functions.geo import haversine_m, to_latlon, to_xy
from ..functions.ordered import exact_percentiles
from .splits import drawn_keys

KINDS = ("teleport", "speed", "noise", "detour", "loop")


def inject(windows: DataFrame, length: int, kinds=KINDS, rate: float = 0.1, seeds=(0,), teleport_km=(5.0, 50.0),
           speed_factor: float = 6.0, noise_m: float = 300.0) -> DataFrame:
    """(kind, eval_seed, window_id, pos, t, lat, lon, is_bad) with fresh trajectory ids.

    ``max(1, round(rate * n))`` windows are corrupted, at least one stays normal.
    """
    if length < 6:
        raise ValueError("windows shorter than 6 fixes cannot be corrupted meaningfully")
    unknown = set(kinds) - set(KINDS)
    if unknown:
        raise ValueError(f"unknown anomaly kinds {sorted(unknown)}")
    ids = windows.filter("pos = 0").select("window_id")
    n = ids.count()
    n_bad = min(max(1, round(rate * n)), n - 1)
    # the draw depends on the seed only, so every kind corrupts the same windows
    bad = union_all([drawn_keys(ids, "window_id", n_bad, s, "bad").withColumn("eval_seed", F.lit(s)) for s in seeds])
    lat0, lon0 = windows.agg(F.avg("lat"), F.avg("lon")).first()
    runs = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("eval_seed")) for k in kinds for s in seeds])
    rows = windows.withColumn("_r", F.explode(runs)).select(*windows.columns, "_r.*")
    rows = rows.join(bad.withColumn("_bad", F.lit(True)), ["window_id", "eval_seed"], "left") \
        .withColumn("is_bad", F.coalesce("_bad", F.lit(False))).drop("_bad")
    x, y = to_xy(F.col("lat"), F.col("lon"), lat0, lon0)
    moved = _corrupt(rows.withColumns({"_x": x, "_y": y}), length, teleport_km, speed_factor, noise_m)
    lat, lon = to_latlon(F.col("_nx"), F.col("_ny"), lat0, lon0)
    tag = F.concat(F.lit("#anom:"), F.col("kind"), F.lit(":"), F.col("eval_seed").cast("string"))
    return moved.withColumns({"lat": F.when(F.col("is_bad"), lat).otherwise(F.col("lat")),
                              "lon": F.when(F.col("is_bad"), lon).otherwise(F.col("lon")),
                              "traj_id": F.concat(F.col("traj_id"), tag)}).drop("_x", "_y", "_nx", "_ny")


def middle_span(length: int, seed: Column, key: Column) -> tuple[Column, Column]:
    """Start and end of a drawn span of 30-60 % of the window, never its first or last fix."""
    size = F.bround(length * (0.3 + 0.3 * uniform(seed, "span", key))).cast("bigint")
    n = F.least(F.greatest(size, F.lit(2)), F.lit(length - 2))
    start = 1 + F.pmod(draw_int(seed, "start", key), F.greatest(F.lit(length) - n, F.lit(2)) - 1)
    return start.cast("int"), (start + n).cast("int")


def _corrupt(rows: DataFrame, length: int, teleport_km, speed_factor: float, noise_m: float) -> DataFrame:
    wid, seed, kind = F.col("window_id"), F.col("eval_seed"), F.col("kind")
    s, e = middle_span(length, seed, wid)
    group = ["kind", "eval_seed", "window_id"]
    w, whole = Window.partitionBy(*group).orderBy("pos"), Window.partitionBy(*group)
    lag = lambda c: F.col(c) - F.lag(c).over(w)
    rows = rows.withColumns({"_s": s, "_e": e, "_dx": lag("_x"), "_dy": lag("_y")})
    steps = F.sort_array(F.collect_list(F.struct("pos", "_dx", "_dy")).over(whole))
    rows = rows.withColumn("_steps", F.when(kind == "loop", steps))
    # step number p - 1 leads to position p
    inside = (F.col("pos") - 1 >= F.col("_s")) & (F.col("pos") - 1 < F.col("_e"))
    angle = math.pi / 3 + 4 * math.pi / 3 * uniform(seed, "angle", wid)
    mirror = F.expr("try_element_at(_steps, cast(_s + _e - pos + 2 as int))")
    turned_x = F.cos(angle) * F.col("_dx") - F.sin(angle) * F.col("_dy")
    turned_y = F.sin(angle) * F.col("_dx") + F.cos(angle) * F.col("_dy")

    def step(own, turned, field):
        changed = F.when(kind == "speed", F.col(own) * speed_factor).when(kind == "detour", turned) \
            .when(kind == "loop", -mirror.getField(field)).otherwise(F.col(own))
        return F.when(F.col("pos") == 0, 0.0).when(inside, changed).otherwise(F.col(own))

    rows = rows.withColumns({"_sx": step("_dx", turned_x, "_dx"), "_sy": step("_dy", turned_y, "_dy")})
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    origin = lambda c: F.first(c).over(upto)
    far = (teleport_km[0] + (teleport_km[1] - teleport_km[0]) * uniform(seed, "far", wid)) * 1000.0
    bearing = 2 * math.pi * uniform(seed, "bearing", wid)
    span = (F.col("pos") >= F.col("_s")) & (F.col("pos") < F.col("_e"))
    jitter = lambda axis: noise_m * normal(seed, axis, wid, F.col("pos"))

    def place(c, walked, jump, axis):
        return F.when(kind == "teleport", F.when(span, F.col(c) + jump).otherwise(F.col(c))) \
            .when(kind == "noise", F.col(c) + jitter(axis)).otherwise(origin(c) + F.sum(walked).over(upto))

    out = rows.withColumns({"_nx": place("_x", "_sx", far * F.cos(bearing), "x"), "_ny": place("_y", "_sy", far * F.sin(bearing), "y")})
    return out.drop("_s", "_e", "_dx", "_dy", "_steps", "_sx", "_sy")


def injection_check(original: DataFrame, injected: DataFrame) -> DataFrame:
    """Per kind: median ratios of the longest step and of the path, and the largest relative change of
    the sorted step lengths, over the corrupted windows."""
    def sorted_steps(df, keys):
        w = Window.partitionBy(*keys).orderBy("pos")
        d = haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
        return df.withColumn("_d", d).groupBy(*keys).agg(F.sort_array(F.collect_list("_d")).alias("steps"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    keys = ["kind", "eval_seed", "window_id"]
    bad = injected.filter("is_bad")
    a = sorted_steps(original.select("window_id", "pos", "lat", "lon"), ["window_id"]).withColumnRenamed("steps", "old")
    b = sorted_steps(bad, keys).withColumnRenamed("steps", "new").join(a, "window_id")
    change = F.array_max(F.zip_with("new", "old", lambda n, o: F.abs(n - o) / F.greatest(o, F.lit(1.0))))
    r = b.withColumns({"step_ratio": F.array_max("new") / F.greatest(F.array_max("old"), F.lit(1e-9)),
                       "path_ratio": total(F.col("new")) / F.greatest(total(F.col("old")), F.lit(1e-9)), "change": change})
    out = r.groupBy("kind").agg(F.max("change").alias("step_length_deviation"))
    for name, column in (("max_step_ratio", "step_ratio"), ("total_distance_ratio", "path_ratio")):
        out = out.join(exact_percentiles(r, ["kind"], column, {name: 0.5}), "kind")
    return out
