"""Kinematic features, tokens and trip statistics as column expressions."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import Y_SCALE, haversine_m, time_of_day, to_xy, weekday, x_scale

# Physical bounds of the point tokens.
MAX_OFFSET_KM, MAX_SPEED_MPS = 200.0, 100.0

KINEMATIC = ("v_mean", "v_p50", "v_p85", "v_p95", "v_std", "a_mean", "a_p90", "turn_mean", "share_slow", "path_m", "duration_s")
PLACE = ("lat_mean", "lon_mean", "lat_std", "lon_std", "lat_min", "lat_max", "lon_min", "lon_max")


def _lag(c, w, n=1):
    return F.lag(c, n).over(w)


def window_steps(windows: DataFrame, key: str = "window_id") -> DataFrame:
    """Per position ``step_m`` and ``dt`` from the previous one (windows are of bounded length)."""
    w = Window.partitionBy(key).orderBy("pos")
    step = haversine_m(_lag("lat", w), _lag("lon", w), F.col("lat"), F.col("lon"))
    return windows.withColumns({"step_m": step, "dt": F.col("t") - _lag("t", w)})


def kinematic_features(windows: DataFrame, key: str = "window_id") -> DataFrame:
    """Eleven speed, acceleration and heading statistics per window; each depends on its own row only
    (headings use the window's own cosine), so train and test may be computed apart."""
    w, whole = Window.partitionBy(key).orderBy("pos"), Window.partitionBy(key)
    s = window_steps(windows, key).withColumn("_c", F.cos(F.avg(F.radians("lat")).over(whole)))
    s = s.withColumns({"_y": F.radians("lat"), "_x": F.radians("lon") * F.col("_c"), "_dt": F.greatest("dt", F.lit(1.0))})
    s = s.withColumns({"_v": F.col("step_m") / F.col("_dt"),
                       "_head": F.atan2(F.col("_y") - _lag("_y", w), F.col("_x") - _lag("_x", w))})
    d = F.col("_head") - _lag("_head", w)
    s = s.withColumns({"_a": F.abs((F.col("_v") - _lag("_v", w)) / F.col("_dt")), "_turn": F.abs(F.atan2(F.sin(d), F.cos(d)))})
    q = F.percentile("_v", F.array(F.lit(0.5), F.lit(0.85), F.lit(0.95)))
    g = s.groupBy(key).agg(
        F.avg("_v").alias("v_mean"), q.alias("_q"), F.stddev_pop("_v").alias("v_std"), F.avg("_a").alias("a_mean"),
        F.percentile("_a", 0.9).alias("a_p90"), F.avg("_turn").alias("turn_mean"),
        F.avg(F.when(F.col("_v") < 0.5, 1.0).when(F.col("_v").isNotNull(), 0.0)).alias("share_slow"),
        F.sum("step_m").alias("path_m"), (F.max_by("t", "pos") - F.min_by("t", "pos")).alias("duration_s"))
    return g.withColumns({"v_p50": F.col("_q")[0], "v_p85": F.col("_q")[1], "v_p95": F.col("_q")[2]}).select(key, *KINEMATIC)


def location_features(windows: DataFrame, key: str = "window_id") -> DataFrame:
    parts = []
    for c in ("lat", "lon"):
        parts += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return windows.groupBy(key).agg(*parts).select(key, *PLACE)


def as_vector(features: DataFrame, names, key: str = "window_id", vector: str = "vector") -> DataFrame:
    return features.withColumn(vector, F.array(*[F.col(n).cast("double") for n in names]))


def max_step(windows: DataFrame, key: str = "window_id") -> DataFrame:
    """Largest single displacement of the window."""
    return window_steps(windows, key).groupBy(key).agg(F.max("step_m").alias("score"))


def point_tokens(windows: DataFrame, key: str = "window_id") -> DataFrame:
    """Nine channels per position: offsets in km from the first visible fix, log time step, speed,
    heading, time of day, weekday. Hidden positions (column ``hidden``) carry no spatial channel."""
    w, whole = Window.partitionBy(key).orderBy("pos"), Window.partitionBy(key)
    seen = F.min(F.when(~F.col("hidden"), F.struct("pos", "lat", "lon"))).over(whole)
    r = windows.withColumn("_f", seen)
    kx = x_scale(F.col("_f.lat"))
    off = lambda c, origin, k: F.when(F.col("hidden"), 0.0).otherwise((F.col(c) - F.col(f"_f.{origin}")) * k) / 1000.0
    r = r.withColumns({"_x": off("lon", "lon", kx), "_y": off("lat", "lat", Y_SCALE)})
    r = r.withColumns({"_dt": F.coalesce(F.col("t") - _lag("t", w), F.lit(0.0)),
                       "_dx": F.coalesce((F.col("_x") - _lag("_x", w)) * 1000, F.lit(0.0)),
                       "_dy": F.coalesce((F.col("_y") - _lag("_y", w)) * 1000, F.lit(0.0)),
                       "_known": ~F.col("hidden") & ~F.coalesce(_lag("hidden", w), F.lit(True))})
    speed = F.sqrt(F.col("_dx") ** 2 + F.col("_dy") ** 2) / F.greatest("_dt", F.lit(1.0)) / 10.0
    heading = F.atan2("_dy", "_dx")
    known = lambda c: F.when(F.col("_known"), c).otherwise(0.0)
    clip = lambda c, lo, hi: F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
    s, c = time_of_day(F.col("t"))
    return r.select(key, "pos", clip(F.col("_x"), -MAX_OFFSET_KM, MAX_OFFSET_KM).alias("dx_km"),
                    clip(F.col("_y"), -MAX_OFFSET_KM, MAX_OFFSET_KM).alias("dy_km"),
                    (F.log1p(F.greatest("_dt", F.lit(0.0))) / 5.0).alias("log_dt"),
                    clip(known(speed), 0.0, MAX_SPEED_MPS / 10.0).alias("speed"), known(F.sin(heading)).alias("head_sin"),
                    known(F.cos(heading)).alias("head_cos"), s.alias("tod_sin"), c.alias("tod_cos"), weekday(F.col("t")).alias("weekday"))


def tokens_to_latlon(dx_km: Column, dy_km: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    return lat0 + dy_km * 1000 / Y_SCALE, lon0 + dx_km * 1000 / x_scale(lat0)


def visit_tokens(visits: DataFrame, lat0: float, lon0: float) -> DataFrame:
    """Nine channels per context visit: position (10 km units), arrival and departure time of day, log
    hours of stay and of travel from the previous visit, weekday. (sample_id, k, ...)."""
    v = visits.select("sample_id", "ctx", F.posexplode("ctx").alias("k", "v"))
    before = F.coalesce(F.expr("try_element_at(ctx, nullif(k, 0))").getField("t_leave"), F.col("v.t_leave"))
    x, y = to_xy(F.col("v.lat"), F.col("v.lon"), lat0, lon0)
    clip = lambda c: F.least(F.greatest(c, F.lit(-50.0)), F.lit(50.0))
    si, ci = time_of_day(F.col("v.t_arrive"))
    so, co = time_of_day(F.col("v.t_leave"))
    hours = lambda s: F.log1p(F.greatest(s, F.lit(0.0)) / 3600.0)
    return v.select("sample_id", F.col("k").cast("bigint").alias("k"), clip(x / 10_000.0).alias("x"), clip(y / 10_000.0).alias("y"),
                    si.alias("in_sin"), ci.alias("in_cos"), so.alias("out_sin"), co.alias("out_cos"),
                    hours(F.col("v.t_leave") - F.col("v.t_arrive")).alias("log_stay"),
                    hours(F.col("v.t_arrive") - before).alias("log_travel"), weekday(F.col("v.t_arrive")).alias("weekday"))


def radius_of_gyration(points: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Root mean squared distance to the (weighted) mean position: two combined aggregates."""
    w = F.col(weight) if weight else F.lit(1.0)
    rows = points.withColumn("_w", w)
    mean = lambda c: F.sum(F.col("_w") * F.col(c)) / F.sum("_w")
    centre = rows.groupBy(*keys).agg(mean("lat").alias("_clat"), mean("lon").alias("_clon"))
    d = haversine_m(F.col("lat"), F.col("lon"), F.col("_clat"), F.col("_clon"))
    j = rows.join(centre, keys).withColumn("_d2", d * d)
    return j.groupBy(*keys).agg(F.sqrt(F.sum(F.col("_w") * F.col("_d2")) / F.sum("_w")).alias("rg_m"))


def standardise(df: DataFrame, train: DataFrame, names) -> DataFrame:
    """z-scores with the mean and population deviation of ``train`` (one aggregated row of literals)."""
    stats = train.agg(*[f(n).alias(f"{p}_{n}") for n in names for p, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    z = {}
    for n in names:
        sd = stats[f"s_{n}"]
        z[n] = (F.col(n) - F.lit(stats[f"m_{n}"])) / F.lit(sd if sd and sd > 1e-12 else 1.0)
    return df.withColumns(z)


# Typical speed (m/s) of each mode.
MODE_SPEEDS = {"walk": 1.4, "bike": 4.5, "bus": 7.0, "car": 11.0, "train": 20.0}


def speed_rule(features: DataFrame, classes: list[str], key: str = "window_id") -> DataFrame:
    """Mode logits from the median speed alone."""
    gap = lambda c: -3 * F.abs(F.log(F.col("v_p50") + 0.1) - math.log(MODE_SPEEDS.get(c, 5.0) + 0.0))
    return features.select(key, F.array(*[gap(c) for c in classes]).alias("logits"))
