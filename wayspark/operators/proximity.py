"""Joins by position and time: matched segments, features in a radius, candidate roads."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m, to_xy
from ..session import cut_lineage


def with_segments(points: DataFrame, matches: DataFrame) -> DataFrame:
    """Segment of each fix by (trajectory, time rounded to the microsecond), -1 where unmatched."""
    key = lambda c: F.round(F.col(c) * 1_000_000).cast("bigint").alias("_us")
    m = matches.select("traj_id", key("t"), "seg").dropDuplicates(["traj_id", "_us"])
    out = points.withColumn("_us", key("t")).join(m, ["traj_id", "_us"], "left")
    return out.withColumn("seg", F.coalesce("seg", F.lit(-1)).cast("bigint")).drop("_us")


def _tiles(x, y, side: float):
    return F.floor(x / side).cast("bigint"), F.floor(y / side).cast("bigint")


def within_radius(points: DataFrame, features: DataFrame, key: str, radius_m: float, lat0: float, lon0: float) -> DataFrame:
    """Per fix: number of features within ``radius_m`` and per category index (``category`` optional).

    Both sides are first merged by identical position, features carry a weight. Tiles have the side of
    the radius (padded for the projection); features are copied to the 3 x 3 tiles around them, so the
    join is an equi-join on the tile and adaptive execution can split a crowded one; exact distances
    decide, and counts combine before they are shuffled.
    """
    side = radius_m * 1.02
    fx, fy = to_xy(F.col("lat"), F.col("lon"), lat0, lon0)
    places = points.select("lat", "lon").distinct()
    px, py = _tiles(fx, fy, side)
    p = places.withColumns({"_tx": px, "_ty": py})
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    merged = features.groupBy(F.col("lat").alias("_flat"), F.col("lon").alias("_flon")).agg(F.count(F.lit(1)).alias("_w"))
    gx, gy = to_xy(F.col("_flat"), F.col("_flon"), lat0, lon0)
    tx, ty = _tiles(gx, gy, side)
    f = merged.withColumns({"_x": tx, "_y": ty}).withColumn("_ix", around).withColumn("_iy", around) \
        .select("_flat", "_flon", "_w", (F.col("_x") + F.col("_ix")).alias("_tx"), (F.col("_y") + F.col("_iy")).alias("_ty"))
    d = haversine_m(F.col("lat"), F.col("lon"), F.col("_flat"), F.col("_flon"))
    near = p.join(f, ["_tx", "_ty"]).withColumn("_d", d).filter(F.col("_d") <= radius_m)
    counts = near.groupBy("lat", "lon").agg(F.sum("_w").alias("n_near"), F.min("_d").alias("nearest_m"))
    return points.join(counts, ["lat", "lon"], "left").select(key, F.coalesce("n_near", F.lit(0)).alias("n_near"), "nearest_m")


def _offsets(cuts: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Of tiles ``cuts`` to a radius: offsets of the tiles that lie in the disc around every place of a tile, and of those that a disc may cut. The
    projection is good to 2 % around its centre."""
    inner, rim, reach = [], [], math.ceil(1.02 * cuts)
    for i in range(-reach, reach + 1):
        for j in range(-reach, reach + 1):
            if math.hypot(abs(i) + 1, abs(j) + 1) <= 0.98 * cuts:
                inner.append((i, j))
            elif math.hypot(max(abs(i) - 1, 0), max(abs(j) - 1, 0)) <= 1.02 * cuts:
                rim.append((i, j))
    return inner, rim


def disc_sums(points: DataFrame, features: DataFrame, key: str, radius_m: float, lat0: float, lon0: float, cuts: int = 4) -> DataFrame:
    """Per fix and ``kind``, the sum of ``w`` of the features (lat, lon, kind, w) within ``radius_m``: (key, kind, total); kinds without a feature there have no row.

    Tiles that lie in the disc of every place of a tile enter by their totals, once for the whole tile; exact distances
    are computed at the rim only. Equal positions are searched once on both sides, and all joins are equi-joins on tiles.
    """
    side = radius_m / cuts
    inner, rim = _offsets(cuts)
    x, y = to_xy(F.col("lat"), F.col("lon"), lat0, lon0)
    tx, ty = _tiles(x, y, side)
    places = points.select("lat", "lon").distinct().withColumns({"_px": tx, "_py": ty})
    merged = cut_lineage(features.groupBy("lat", "lon", "kind").agg(F.sum("w").alias("w")).withColumns({"_tx": tx, "_ty": ty}))       # read twice
    steps = lambda offsets: F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets]))
    near = lambda rows, offsets: rows.withColumn("_s", steps(offsets)).withColumns({"_tx": F.col("_px") + F.col("_s.i"), "_ty": F.col("_py") + F.col("_s.j")}).drop("_s")
    totals = merged.groupBy("_tx", "_ty", "kind").agg(F.sum("w").alias("w"))
    whole = near(places.select("_px", "_py").distinct(), inner).join(totals, ["_tx", "_ty"]).groupBy("_px", "_py", "kind").agg(F.sum("w").alias("w"))
    sure = places.join(whole, ["_px", "_py"]).select("lat", "lon", "kind", "w")
    at_rim = near(places, rim).join(merged.withColumnsRenamed({"lat": "_flat", "lon": "_flon"}), ["_tx", "_ty"])
    cut = at_rim.filter(haversine_m(F.col("lat"), F.col("lon"), F.col("_flat"), F.col("_flon")) <= radius_m).select("lat", "lon", "kind", "w")
    found = sure.unionByName(cut).groupBy("lat", "lon", "kind").agg(F.sum("w").alias("total"))
    return points.select(key, "lat", "lon").join(found, ["lat", "lon"]).select(key, "kind", "total")


def category_counts(points: DataFrame, features: DataFrame, key: str, radius_m: float, lat0: float, lon0: float) -> DataFrame:
    """Per fix and category, the number of features (lat, lon, category) within ``radius_m``: (key, category, n_near)."""
    rows = features.select("lat", "lon", F.col("category").alias("kind"), F.lit(1).cast("bigint").alias("w"))
    return disc_sums(points, rows, key, radius_m, lat0, lon0).withColumnsRenamed({"kind": "category", "total": "n_near"})


def mean_vector(points: DataFrame, features: DataFrame, key: str, radius_m: float, lat0: float, lon0: float) -> DataFrame:
    """Per fix, the mean ``vector`` of the features within ``radius_m`` and their number: (key, n_near, vector); fixes without features have no row."""
    one = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(1.0).alias("w")))
    parts = F.explode(F.concat(one, F.transform("vector", lambda v, i: F.struct(i.alias("kind"), v.cast("double").alias("w"))))).alias("p")
    sums = disc_sums(points, features.select("lat", "lon", parts).select("lat", "lon", "p.*"), key, radius_m, lat0, lon0)
    n = F.max(F.when(F.col("kind") == -1, F.col("total")))
    values = F.sort_array(F.collect_list(F.when(F.col("kind") >= 0, F.struct("kind", "total"))))            # as long as a vector
    grouped = sums.groupBy(key).agg(n.alias("n"), values.alias("v"))
    return grouped.select(key, F.col("n").cast("bigint").alias("n_near"), F.transform("v", lambda r: r["total"] / F.col("n")).alias("vector"))


def coverage_summary(near: DataFrame) -> DataFrame:
    """Share of fixes with any feature and the mean number of features."""
    return near.agg(F.avg(F.when(F.col("n_near") > 0, 1.0).otherwise(0.0)).alias("share_any"), F.avg("n_near").alias("mean_near"))


def road_pieces(segments: DataFrame, lat0: float, lon0: float) -> DataFrame:
    """Straight pieces of segment geometries with the offset of their start along the segment.
    ``segments``: (seg_id, oneway, geom ARRAY<STRUCT<lat, lon>>)."""
    v = segments.select("seg_id", F.posexplode("geom").alias("k", "g"))
    x, y = to_xy(F.col("g.lat"), F.col("g.lon"), lat0, lon0)
    v = v.withColumns({"x": x, "y": y})
    w = Window.partitionBy("seg_id").orderBy("k")
    p = v.withColumns({"x1": F.lead("x").over(w), "y1": F.lead("y").over(w)}).filter("x1 is not null")
    p = p.withColumn("len", F.sqrt((F.col("x1") - F.col("x")) ** 2 + (F.col("y1") - F.col("y")) ** 2))
    off = F.sum("len").over(w) - F.col("len")
    return p.select("seg_id", "k", F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", "y1", "len", off.alias("off"))


def place_roads(points: DataFrame, pieces: DataFrame, radius_m: float, k: int, lat0: float, lon0: float, tile_m: float | None = None) -> DataFrame:
    """Nearest piece of every segment within ``radius_m`` of a position of ``points``, the ``k`` nearest segments:
    (lat, lon, x, y, seg_id, dist, off). Equal positions are searched once. Roads that meet in a node are as near as
    each other up to rounding: distances equal to a micrometre are ties, and the smaller seg_id goes first.

    A piece is copied to the tiles that its box, grown by the radius, touches; a fix lies in one tile.
    """
    side = tile_m or max(2 * radius_m, 100.0)
    x, y = to_xy(F.col("lat"), F.col("lon"), lat0, lon0)
    tx, ty = _tiles(x, y, side)
    places = points.select("lat", "lon").distinct().withColumns({"x": x, "y": y, "_tx": tx, "_ty": ty})
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - radius_m) / side).cast("bigint"), F.floor((F.greatest(a, b) + radius_m) / side).cast("bigint"))
    tiles = pieces.withColumn("_tx", F.explode(span("x0", "x1"))).withColumn("_ty", F.explode(span("y0", "y1")))
    j = places.join(tiles, ["_tx", "_ty"])
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    s = ((F.col("x") - F.col("x0")) * dx + (F.col("y") - F.col("y0")) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-12))
    s = F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))
    j = j.withColumn("_s", s)
    dist = F.sqrt((F.col("x") - F.col("x0") - F.col("_s") * dx) ** 2 + (F.col("y") - F.col("y0") - F.col("_s") * dy) ** 2)
    near = j.withColumns({"dist": dist, "off": F.col("off") + F.col("_s") * F.col("len")}).filter(F.col("dist") <= radius_m)
    per = near.groupBy("lat", "lon", "x", "y", "seg_id").agg(F.min(F.struct("dist", "off")).alias("b"))
    best = per.select("lat", "lon", "x", "y", "seg_id", F.col("b.dist").alias("dist"), F.col("b.off").alias("off"))
    rank = F.row_number().over(Window.partitionBy("lat", "lon").orderBy(F.round("dist", 6), "seg_id"))
    return best.withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r")


def candidate_roads(points: DataFrame, pieces: DataFrame, radius_m: float, k: int, lat0: float, lon0: float, tile_m: float | None = None) -> DataFrame:
    """``place_roads`` of every fix: (traj_id, t, x, y, seg_id, dist, off)."""
    top = place_roads(points, pieces, radius_m, k, lat0, lon0, tile_m)
    return points.select("traj_id", "t", "lat", "lon").join(top, ["lat", "lon"]).select("traj_id", "t", "x", "y", "seg_id", "dist", "off")
