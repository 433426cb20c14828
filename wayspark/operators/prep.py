"""Cleaning and per-dataset preparation of the point table."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_M, METRES_PER_DEGREE, haversine_m
from ..functions.ordered import by_day, exact_percentiles, group_size, last_known, neighbour, numbered, over_groups, running
from ..functions.scan import keep_scan
from ..session import cut_lineage

per_trajectory = over_groups("traj_id", chunk=by_day)


def valid_fixes(points: DataFrame) -> DataFrame:
    """Rows with every field present, inside the coordinate range and not at (0, 0)."""
    lat, lon = F.col("lat"), F.col("lon")
    present = ~F.isnan("lat") & ~F.isnan("lon") & ~F.isnan("t")
    return points.dropna(subset=["user_id", "traj_id", "t", "lat", "lon"]).filter(
        present & lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0)))


def first_per_time(points: DataFrame, tie: list[str]) -> DataFrame:
    """One row per (trajectory, time): the first in ``tie`` order. Combines before the shuffle."""
    keys = ["traj_id", "t"]
    rest = [c for c in points.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*tie)).alias("_row")
    return points.groupBy(*keys).agg(first).select(*keys, "_row.*").select(*points.columns)


def _speed_from(lat1, lon1, t1, lat2, lon2, t2) -> Column:
    return haversine_m(lat1, lon1, lat2, lon2) / F.greatest(t2 - t1, F.lit(1.0))


def _haversine(a, b) -> float:
    p1, p2 = math.radians(a[1]), math.radians(b[1])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(
        (math.radians(b[2]) - math.radians(a[2])) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(min(max(h, 0.0), 1.0)))


def _fast(max_speed_mps: float) -> Column:
    return _speed_from(F.col("_p_lat"), F.col("_p_lon"), F.col("_p_t"), F.col("lat"), F.col("lon"), F.col("t")) > max_speed_mps


@per_trajectory
def speed_filter(points: DataFrame, max_speed_mps: float, chunk: Column | None) -> DataFrame:
    """Drop fixes that imply an impossible speed from the last *kept* fix of the trajectory.

    Only a trajectory with at least one too-fast step between *neighbouring* fixes can lose a fix,
    so all others pass as they are and only the suspicious ones are scanned in order. The flagged
    rows are written once, as both ways read them.
    """
    near = neighbour(points, ["traj_id"], ["t"], ["t", "lat", "lon"], "_p_", chunk).withColumn("_fast", F.coalesce(_fast(max_speed_mps), F.lit(False)))
    if chunk is None:
        flagged = near.withColumn("_odd", F.max("_fast").over(Window.partitionBy("traj_id")))
    else:
        odd = near.filter("_fast").select("traj_id").distinct().withColumn("_odd", F.lit(True))
        flagged = near.join(odd, "traj_id", "left").withColumn("_odd", F.coalesce("_odd", F.lit(False)))
    flagged = cut_lineage(flagged.select(*points.columns, "_odd"))
    clear, odd = (flagged.filter(c).select(*points.columns) for c in ("not _odd", "_odd"))

    def keep(last, row):
        return _haversine(last, row) / max(row[0] - last[0], 1.0) <= max_speed_mps
    return clear.unionByName(keep_scan(odd, ["traj_id"], ["t"], ["t", "lat", "lon"], keep))


@per_trajectory
def speed_filter_lag(points: DataFrame, max_speed_mps: float, chunk: Column | None) -> DataFrame:
    """The same test against the previous *raw* fix, whether or not that one survives."""
    near = neighbour(points, ["traj_id"], ["t"], ["t", "lat", "lon"], "_p_", chunk)
    return near.filter(~F.coalesce(_fast(max_speed_mps), F.lit(False))).select(*points.columns)


@per_trajectory
def long_enough(points: DataFrame, min_points: int | None = None, max_points: int | None = None, *, chunk: Column | None) -> DataFrame:
    """Trajectories with a number of fixes in the given range; the sizes come with the rows, so nothing upstream runs twice."""
    sized = group_size(points, ["traj_id"], "_n", chunk)
    if min_points:
        sized = sized.filter(F.col("_n") >= min_points)
    if max_points:
        sized = sized.filter(F.col("_n") <= max_points)
    return sized.select(*points.columns)


@per_trajectory
def clean_points(points: DataFrame, max_speed_mps: float = 70.0, min_points: int = 2,
                 drop_duplicate_times: bool = True, tie: list[str] | None = None, *, chunk: Column | None) -> DataFrame:
    """Valid fixes, one per time, no impossible speeds, no trajectory below ``min_points``."""
    p = valid_fixes(points)
    if drop_duplicate_times:
        p = first_per_time(p, tie or ["lat", "lon"])
    return long_enough(speed_filter(p, max_speed_mps, chunk=chunk), min_points, chunk=chunk)


# ------------------------------------------------------------------ prepare steps
def inside_bbox(points: DataFrame, lat_min: float, lat_max: float, lon_min: float, lon_max: float) -> DataFrame:
    """Trajectories lying entirely in the box: those with a fix outside are removed."""
    out = points.filter(~(F.col("lat").between(lat_min, lat_max) & F.col("lon").between(lon_min, lon_max)))
    return points.join(out.select("traj_id").distinct(), "traj_id", "left_anti")


def between_times(points: DataFrame, t_from: float | None = None, t_to: float | None = None) -> DataFrame:
    if t_from is not None:
        points = points.filter(F.col("t") >= t_from)
    if t_to is not None:
        points = points.filter(F.col("t") <= t_to)
    return points


@per_trajectory
def every_nth(points: DataFrame, n: int, chunk: Column | None) -> DataFrame:
    counted = numbered(points, ["traj_id"], ["t"], "_i", chunk)
    return counted.filter((F.col("_i") - 1) % n == 0).select(*points.columns)


@per_trajectory
def min_interval(points: DataFrame, seconds: float, chunk: Column | None) -> DataFrame:
    """Keep a fix only if at least ``seconds`` after the last kept one.

    A fix that far from its direct predecessor is always kept, so the scan restarts there: dense
    runs are the groups, and a run of one fix needs no scan at all.
    """
    near = neighbour(points, ["traj_id"], ["t"], ["t"], "_p_", chunk)
    opens = (F.col("_p_t").isNull() | (F.col("t") - F.col("_p_t") >= seconds)).cast("bigint")
    runs = running(near, ["traj_id"], ["t"], {"_run": opens}, chunk).drop("_p_t")
    return keep_scan(runs, ["traj_id", "_run"], ["t"], ["t"], lambda last, row: row[0] - last[0] >= seconds) \
        .select(*points.columns)


def frequent_users(points: DataFrame, min_trajectories: int) -> DataFrame:
    trips = points.select("user_id", "traj_id").distinct().groupBy("user_id").agg(F.count(F.lit(1)).alias("_k"))
    return points.join(trips.filter(F.col("_k") >= min_trajectories).select("user_id"), "user_id", "left_semi")


def prepare(points: DataFrame, min_interval_s: float | None = None, nth: int | None = None,
            min_traj_points: int | None = None, max_traj_points: int | None = None, t_from: float | None = None,
            t_to: float | None = None, min_user_trajectories: int | None = None, bbox=None) -> DataFrame:
    """All steps in their fixed order: box, times, thinning, lengths, users."""
    if bbox is not None:
        points = inside_bbox(points, *bbox)
    points = between_times(points, t_from, t_to)
    if nth and nth > 1:
        points = every_nth(points, nth)
    if min_interval_s:
        points = min_interval(points, min_interval_s)
    if min_traj_points or max_traj_points:
        points = long_enough(points, min_traj_points, max_traj_points)
    if min_user_trajectories:
        points = frequent_users(points, min_user_trajectories)
    return points


@per_trajectory
def gap_segments(points: DataFrame, max_gap_s: float, chunk: Column | None) -> DataFrame:
    """Adds ``seg``: the number of gaps above ``max_gap_s`` so far in the trajectory."""
    near = neighbour(points, ["traj_id"], ["t"], ["t"], "_p_", chunk)
    cut = F.when(F.col("t") - F.col("_p_t") > max_gap_s, 1).otherwise(0).cast("bigint")
    return running(near, ["traj_id"], ["t"], {"seg": cut}, chunk).drop("_p_t")


# ------------------------------------------------------------------ profiles
@per_trajectory
def step_table(points: DataFrame, chunk: Column | None) -> DataFrame:
    """Per fix: ``step_m`` and ``dt`` from the previous fix of the trajectory (null at the first)."""
    near = neighbour(points, ["traj_id"], ["t"], ["t", "lat", "lon"], "_p_", chunk)
    step = haversine_m(F.col("_p_lat"), F.col("_p_lon"), F.col("lat"), F.col("lon"))
    return near.withColumns({"step_m": step, "dt": F.col("t") - F.col("_p_t")}).drop("_p_t", "_p_lat", "_p_lon")


def trajectory_profile(points: DataFrame, still_m: float = 0.5) -> DataFrame:
    """Size, timing, length and stillness of every trajectory, with its first position."""
    steps = step_table(points)
    one = steps.groupBy("traj_id").agg(
        F.count(F.lit(1)).alias("n_points"), (F.max("t") - F.min("t")).alias("duration_s"),
        F.max("dt").alias("dt_max_s"), F.sum("step_m").alias("path_m"),
        F.max(F.col("step_m") / F.greatest(F.col("dt"), F.lit(1e-9))).alias("max_step_mps"),
        F.avg(F.when(F.col("step_m") < still_m, 1.0).when(F.col("step_m").isNotNull(), 0.0)).alias("share_still"),
        F.min_by(F.struct("lat", "lon"), "t").alias("_first"))
    median = exact_percentiles(steps, ["traj_id"], "dt", {"dt_median_s": 0.5})
    speed = F.col("path_m") / F.greatest(F.col("duration_s"), F.lit(1e-9))
    return one.join(median, "traj_id", "left").select(
        "traj_id", "n_points", "duration_s", "dt_median_s", "dt_max_s", "path_m", speed.alias("mean_speed_mps"),
        "max_step_mps", "share_still", F.col("_first.lat").alias("first_lat"), F.col("_first.lon").alias("first_lon"))


@per_trajectory
def _placed(points: DataFrame, chunk: Column | None) -> DataFrame:
    """Adds the 0-based position and the size of the trajectory."""
    counted = numbered(points, ["traj_id"], ["t"], "p", chunk).withColumn("p", F.col("p") - 1)
    return group_size(counted, ["traj_id"], "n", chunk)


def find_in_raw(sample: DataFrame, raw: DataFrame, decimals: int = 6) -> DataFrame:
    """Where each sample trajectory starts in the raw data: exact match of the first fix on
    (time, rounded coordinates), with its offset there and whether the whole trajectory is covered."""
    key = [F.col("t").alias("k_t"), F.round("lat", decimals).alias("k_lat"), F.round("lon", decimals).alias("k_lon")]
    first = sample.groupBy("traj_id").agg(F.min_by(F.struct("t", "lat", "lon"), "t").alias("f"),
                                          F.count(F.lit(1)).alias("n_sample"))
    first = first.select("traj_id", "n_sample", F.col("f.t").alias("t"), F.col("f.lat").alias("lat"),
                         F.col("f.lon").alias("lon")).select(F.col("traj_id").alias("sample_id"), "n_sample", *key)
    places = _placed(raw).select(F.col("traj_id").alias("raw_id"), F.col("p").alias("offset"), F.col("n").alias("n_raw"), *key)
    hit = first.join(places, ["k_t", "k_lat", "k_lon"])
    whole = (F.col("offset") == 0) & (F.col("n_sample") == F.col("n_raw"))
    return hit.select("sample_id", "raw_id", "offset", whole.alias("whole"))


def decimals_share(points: DataFrame, column: str = "lat", more_than: int = 6) -> DataFrame:
    """Share of fixes written with more than ``more_than`` decimals."""
    digits = F.length(F.regexp_replace(F.format_number(F.abs(F.col(column)) % 1, 12), "^0?\\.|0+$", ""))
    return points.agg(F.avg((digits > more_than).cast("double")).alias("share"), F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ extents
def bbox(points: DataFrame, pad_m: float = 0.0) -> DataFrame:
    """Padded bounds of the data in one row."""
    b = points.agg(F.min("lat").alias("a0"), F.max("lat").alias("a1"), F.min("lon").alias("o0"),
                   F.max("lon").alias("o1"), F.avg("lat").alias("mid"))
    pad_lat = pad_m / METRES_PER_DEGREE
    pad_lon = pad_m / (METRES_PER_DEGREE * F.greatest(F.cos(F.radians("mid")), F.lit(0.01)))
    return b.select((F.col("a0") - pad_lat).alias("lat_min"), (F.col("a1") + pad_lat).alias("lat_max"),
                    (F.col("o0") - pad_lon).alias("lon_min"), (F.col("o1") + pad_lon).alias("lon_max"))


def bbox_area_km2(box: DataFrame) -> DataFrame:
    """Height times width along the southern edge."""
    a0, a1, o0, o1 = (F.col(c) for c in ("lat_min", "lat_max", "lon_min", "lon_max"))
    return box.withColumn("area_km2", haversine_m(a0, o0, a1, o0) / 1000 * (haversine_m(a0, o0, a0, o1) / 1000))


def suggest_radius(box: DataFrame, n: int, neighbours: float = 8.0) -> DataFrame:
    """Radius whose disc holds about ``neighbours`` of ``n`` features at the mean density of the area,
    within [50, 2000] m; 500 m without features."""
    density = n / F.greatest(F.col("area_km2"), F.lit(1e-6))
    radius = F.sqrt(neighbours / (math.pi * density)) * 1000 if n else F.lit(500.0)
    return bbox_area_km2(box).withColumn("radius_m", F.least(F.greatest(radius, F.lit(50.0)), F.lit(2000.0)))


def clip_to_bbox(features: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    lat_min, lat_max, lon_min, lon_max = box
    return features.filter(F.col("lat").between(lat_min, lat_max) & F.col("lon").between(lon_min, lon_max))


@over_groups("user_id", chunk=lambda: by_day("_at"))
def as_of(rows: DataFrame, order: list[str], column: str, name: str, chunk: Column | None) -> DataFrame:
    """As-of fill per user along ``_at``."""
    return last_known(rows, ["user_id"], order, column, name, chunk)


def labels_by_interval(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Mode of the interval that started last before each fix, if it still holds (end inclusive); of two with one start, the
    one that ends later.

    ``labels``: user_id, start, end, mode. As-of join by union: no pair of a fix and an interval that
    is not its own is ever formed.
    """
    fixes = points.drop("mode").withColumns({"_at": F.col("t"), "_side": F.lit(1), "_label": F.lit(None).cast(
        "struct<start:double,end:double,mode:string>"), "_end": F.lit(None).cast("double")})
    starts = labels.select("user_id", F.col("start").alias("_at"), F.lit(0).alias("_side"),
                           F.struct("start", "end", "mode").alias("_label"), F.col("end").cast("double").alias("_end"))
    both = fixes.unionByName(starts, allowMissingColumns=True)
    filled = as_of(both, ["_at", "_side", "_end"], "_label", "_known")
    mode = F.when(F.col("t") <= F.col("_known.end"), F.col("_known.mode"))
    return filled.filter("_side = 1").withColumn("mode", mode).drop("_at", "_side", "_end", "_label", "_known")
