"""Preparation, splits, grids and views (P, D, V)."""
from __future__ import annotations

from pyspark.sql import functions as F

from wayspark.operators import grid as G
from wayspark.operators import prep, splits, views
from wayspark.plans import info
from wayspark import schema

from .common import longs, rounded
from .inputs import LENGTH, CONTEXT, Inputs, hav, sql, sql_cell, sql_hex

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


# ------------------------------------------------------------------ slice
@query("D12_dataset_summary", sql("""
    , n AS (SELECT * FROM (VALUES ('train'), ('val'), ('test')) v(split)),
    pt AS (SELECT tr.split, count(*) AS n_points, count(DISTINCT p.user_id) AS n_users, count(DISTINCT p.traj_id) AS n_trips
           FROM points p JOIN trips tr ON tr.traj_id = p.traj_id GROUP BY tr.split),
    wn AS (SELECT split, count(DISTINCT window_id) AS n_windows FROM win GROUP BY split),
    sn AS (SELECT s.split, count(*) AS n_stays, round(avg(CASE WHEN s.cell IN (SELECT cell FROM stays WHERE split = 'train') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share_in_train_cells
           FROM stays s GROUP BY s.split),
    vn AS (SELECT split, count(*) AS n_visits FROM tgt GROUP BY split)
    SELECT n.split, n_users, n_trips, n_points, coalesce(n_windows, 0) AS n_windows, coalesce(n_stays, 0) AS n_stays,
           coalesce(n_visits, 0) AS n_visits, share_in_train_cells
    FROM n LEFT JOIN pt USING (split) LEFT JOIN wn USING (split) LEFT JOIN sn USING (split) LEFT JOIN vn USING (split)""",
    "points", "trips", "win", "stays", "tgt"))
def info_summary(d: Inputs):
    return rounded(info.summary(d.points(), d.trips(), d.windows(), d.stays(), d.visits()), share_in_train_cells=6)


@query("validate_points", sql("""SELECT count(*) AS n_points,
    CAST(sum(CASE WHEN lat IS NULL OR lon IS NULL OR t IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing,
    CAST(sum(CASE WHEN lat < -90 OR lat > 90 THEN 1 ELSE 0 END) AS BIGINT) AS n_bad_lat,
    CAST(sum(CASE WHEN lon < -180 OR lon > 180 THEN 1 ELSE 0 END) AS BIGINT) AS n_bad_lon,
    CAST(sum(CASE WHEN lat = 0 AND lon = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_null_island FROM dirty""", "dirty"))
def validate(d):
    return schema.validate_points(d.dirty())


# ------------------------------------------------------------------ P
_CLEAN = {
    "c0": (["dirty"], "SELECT * FROM dirty WHERE lat IS NOT NULL AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0)"),
    "c1": (["c0"], "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY traj_id, t ORDER BY row_no) AS d FROM c0) WHERE d = 1"),
    "c2": (["c1"], "SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY t) AS r FROM c1"),
    "c3": (["c2"], f"""SELECT traj_id, r, t AS lt, lat AS llat, lon AS llon, true AS kept FROM c2 WHERE r = 1
        UNION ALL SELECT x.traj_id, x.r, CASE WHEN ok THEN t ELSE lt END, CASE WHEN ok THEN lat ELSE llat END,
          CASE WHEN ok THEN lon ELSE llon END, ok FROM
          (SELECT n.*, c3.lt, c3.llat, c3.llon, {hav('c3.llat', 'c3.llon', 'n.lat', 'n.lon')} / greatest(n.t - c3.lt, 1.0::DOUBLE) <= 70 AS ok
           FROM c3 JOIN c2 n ON n.traj_id = c3.traj_id AND n.r = c3.r + 1) x"""),
}


@query("P1_clean_points", sql("""SELECT user_id, traj_id, t, round(lat, 8) AS lat, round(lon, 8) AS lon, mode, row_no FROM
    (SELECT c2.*, count(*) OVER (PARTITION BY c2.traj_id) AS k FROM c2 JOIN c3 ON c2.traj_id = c3.traj_id AND c2.r = c3.r AND c3.kept)
    WHERE k >= 2""", "c2", "c3", extra=_CLEAN))
def p1(d):
    return rounded(prep.clean_points(d.dirty(), 70.0, 2, tie=["row_no"]), lat=8, lon=8)


@query("P2_speed_filter_lag", sql(f"""SELECT user_id, traj_id, t, row_no FROM
    (SELECT *, {hav('plat', 'plon', 'lat', 'lon')} / greatest(t - pt, 1.0::DOUBLE) AS v FROM
      (SELECT *, lag(t) OVER w AS pt, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM c1
       WINDOW w AS (PARTITION BY traj_id ORDER BY t))) WHERE v IS NULL OR v <= 60""", "c1", extra=_CLEAN))
def p2(d):
    p = prep.first_per_time(prep.valid_fixes(d.dirty()), ["row_no"])
    return prep.speed_filter_lag(p, 60.0).select("user_id", "traj_id", "t", "row_no")


@query("P3_bbox_whole_trips", sql("""SELECT user_id, traj_id, t, mode FROM points WHERE traj_id NOT IN
    (SELECT traj_id FROM points WHERE NOT (lat BETWEEN 55.605 AND 55.640 AND lon BETWEEN 12.49 AND 12.53))""", "points"))
def p3(d):
    return prep.inside_bbox(d.points(), 55.605, 55.640, 12.49, 12.53).select("user_id", "traj_id", "t", "mode")


@query("P4_time_range", sql("""SELECT user_id, traj_id, t FROM points WHERE t >= 1704100000 AND t <= 1704200000""", "points"))
def p4(d):
    return prep.between_times(d.points(), 1704100000.0, 1704200000.0).select("user_id", "traj_id", "t")


@query("P5_every_nth", sql("""SELECT user_id, traj_id, t FROM (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY t) - 1 AS i FROM points)
    WHERE i % 3 = 0""", "points"))
def p5(d):
    return prep.every_nth(d.points(), 3).select("user_id", "traj_id", "t")


@query("P6_min_interval", sql("""SELECT r.traj_id, r.t FROM r WHERE kept""", "r", extra={
    "m0": (["points"], "SELECT traj_id, t, row_number() OVER (PARTITION BY traj_id ORDER BY t) AS n FROM points"),
    "r": (["m0"], """SELECT traj_id, n, t, t AS last, true AS kept FROM m0 WHERE n = 1 UNION ALL
        SELECT m0.traj_id, m0.n, m0.t, CASE WHEN m0.t - r.last >= 40 THEN m0.t ELSE r.last END, m0.t - r.last >= 40
        FROM r JOIN m0 ON m0.traj_id = r.traj_id AND m0.n = r.n + 1""")}))
def p6(d):
    return prep.min_interval(d.points(), 40.0).select("traj_id", "t")


@query("P7_traj_length", sql("""SELECT user_id, traj_id, t FROM (SELECT *, count(*) OVER (PARTITION BY traj_id) AS n FROM c1) WHERE n BETWEEN 5 AND 8""",
                             "c1", extra=_CLEAN))
def p7(d):
    p = prep.first_per_time(prep.valid_fixes(d.dirty()), ["row_no"])
    return prep.long_enough(p, 5, 8).select("user_id", "traj_id", "t")


@query("P8_min_user_trajectories", sql("""SELECT user_id, traj_id, t FROM points WHERE user_id IN
    (SELECT user_id FROM points GROUP BY user_id HAVING count(DISTINCT traj_id) >= 9)""", "points"))
def p8(d):
    return prep.frequent_users(d.points(), 9).select("user_id", "traj_id", "t")


@query("P3_P8_prepare", sql(""", b AS (SELECT * FROM points WHERE traj_id NOT IN
       (SELECT traj_id FROM points WHERE NOT (lat BETWEEN 55.595 AND 55.64 AND lon BETWEEN 12.49 AND 12.54)) AND t >= 1704067200),
     c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY t) - 1 AS i FROM b) WHERE i % 2 = 0),
     f2 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY traj_id) AS n FROM c) WHERE n BETWEEN 3 AND 100)
     SELECT user_id, traj_id, t FROM f2 WHERE user_id IN (SELECT user_id FROM f2 GROUP BY user_id HAVING count(DISTINCT traj_id) >= 3)""",
     "points"))
def p_all(d):
    return prep.prepare(d.points(), nth=2, min_traj_points=3, max_traj_points=100, t_from=1704067200.0,
                        min_user_trajectories=3, bbox=(55.595, 55.64, 12.49, 12.54)).select("user_id", "traj_id", "t")


@query("P9_gap_segments", sql("""SELECT traj_id, t, CAST(sum(CASE WHEN t - pt > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY traj_id ORDER BY t) AS BIGINT) AS seg
    FROM steps""", "steps"))
def p9(d):
    return prep.gap_segments(d.points(), 30.0).select("traj_id", "t", "seg")


@query("P10_labels_interval_join", sql("""SELECT f.traj_id, f.t, arg_max(CASE WHEN f.t <= l.e THEN l.mode END, l.s) AS mode FROM points f LEFT JOIN
    (SELECT user_id, min(t) AS s, max(t) - 60 AS e, min(mode) AS mode FROM points GROUP BY user_id, traj_id) l
    ON l.user_id = f.user_id AND l.s <= f.t GROUP BY f.traj_id, f.t""", "points").replace(
    "arg_max(CASE WHEN f.t <= l.e THEN l.mode END, l.s)", "CASE WHEN f.t <= max_by(l.e, l.s) THEN max_by(l.mode, l.s) END"))
def p10(d):
    labels = d.points().groupBy("user_id", "traj_id").agg(
        F.min("t").alias("start"), (F.max("t") - 60).alias("end"), F.min("mode").alias("mode")).drop("traj_id")
    return prep.labels_by_interval(d.points(), labels).select("traj_id", "t", "mode")


@query("P11_bbox_area_radius", sql(f"""SELECT round(lat_min, 8) AS lat_min, round(lat_max, 8) AS lat_max, round(lon_min, 8) AS lon_min, round(lon_max, 8) AS lon_max,
     round(area, 6) AS area_km2, round(least(greatest(sqrt(8.0::DOUBLE * area * 1e6::DOUBLE / (pi() * n)), 50.0::DOUBLE), 2000.0::DOUBLE), 4) AS radius_m FROM
     (SELECT *, {hav('lat_min', 'lon_min', 'lat_max', 'lon_min')} / 1000 * ({hav('lat_min', 'lon_min', 'lat_min', 'lon_max')} / 1000) AS area FROM
     (SELECT min(lat) - 500.0::DOUBLE/111195.0::DOUBLE AS lat_min, max(lat) + 500.0::DOUBLE/111195.0::DOUBLE AS lat_max,
       min(lon) - 500.0::DOUBLE/(111195.0::DOUBLE*cos(radians(avg(lat)))) AS lon_min, max(lon) + 500.0::DOUBLE/(111195.0::DOUBLE*cos(radians(avg(lat)))) AS lon_max,
       count(DISTINCT traj_id) AS n FROM points))""", "points"))
def p11(d):
    n = d.points().select("traj_id").distinct().count()
    r = prep.suggest_radius(prep.bbox(d.points(), 500.0), n)
    return rounded(r, lat_min=8, lat_max=8, lon_min=8, lon_max=8, area_km2=6, radius_m=4)


@query("P11_clip_thin", sql(f"""SELECT traj_id, t FROM (SELECT * FROM points WHERE lat BETWEEN 55.60 AND 55.63 AND lon BETWEEN 12.50 AND 12.53)
    WHERE traj_id IN (SELECT traj_id FROM (SELECT DISTINCT traj_id FROM points WHERE lat BETWEEN 55.60 AND 55.63 AND lon BETWEEN 12.50 AND 12.53)
      ORDER BY {sql_hex(3, 'cap', 'traj_id')}, traj_id LIMIT 40)""", "points"))
def p11b(d):
    clipped = prep.clip_to_bbox(d.points(), (55.60, 55.63, 12.50, 12.53))
    return splits.seeded_subset(clipped, "traj_id", 40, seed=3).select("traj_id", "t")


@query("P13_category_vocab", sql("""SELECT mode AS category, CAST(row_number() OVER (ORDER BY n DESC, mode) - 1 AS BIGINT) AS index, n FROM
    (SELECT mode, count(*) AS n FROM points GROUP BY mode ORDER BY n DESC, mode LIMIT 3)""", "points"))
def p13(d):
    return G.category_vocabulary(d.points().withColumnRenamed("mode", "category"), 4)


@query("P14_trajectory_profile", sql(f"""SELECT traj_id, count(*) AS n_points, max(t) - min(t) AS duration_s, quantile_cont(t - pt, 0.5) AS dt_median_s,
    max(t - pt) AS dt_max_s, round(sum(d), 4) AS path_m, round(sum(d) / greatest(max(t) - min(t), 1e-9::DOUBLE), 6) AS mean_speed_mps,
    round(max(d / greatest(t - pt, 1e-9::DOUBLE)), 6) AS max_step_mps, round(avg(CASE WHEN d < 0.5 THEN 1.0::DOUBLE WHEN d IS NOT NULL THEN 0.0::DOUBLE END), 6) AS share_still,
    arg_min(lat, t) AS first_lat, arg_min(lon, t) AS first_lon
    FROM (SELECT *, {hav('plat', 'plon', 'lat', 'lon')} AS d FROM steps) GROUP BY traj_id""", "steps"))
def p14(d):
    return rounded(prep.trajectory_profile(d.points()), path_m=4, mean_speed_mps=6, max_step_mps=6, share_still=6)


@query("P15_find_sample_in_raw", sql("""SELECT s.traj_id AS sample_id, r.traj_id AS raw_id, r.i AS offset, r.i = 0 AND s.n = z.n AS whole FROM
     (SELECT traj_id, min(t) AS t, arg_min(lat, t) AS lat, arg_min(lon, t) AS lon, count(*) AS n FROM
        (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY t) AS i FROM points) WHERE i > 2 GROUP BY traj_id) s
     JOIN (SELECT *, CAST(row_number() OVER (PARTITION BY traj_id ORDER BY t) - 1 AS BIGINT) AS i FROM points) r
       ON r.t = s.t AND round(r.lat, 6) = round(s.lat, 6) AND round(r.lon, 6) = round(s.lon, 6)
     JOIN (SELECT traj_id, count(*) AS n FROM points GROUP BY traj_id) z ON z.traj_id = r.traj_id""", "points"))
def p15(d):
    tail = prep._placed(d.points()).filter("p >= 2").drop("p", "n")
    return prep.find_in_raw(tail, d.points())


@query("P16_decimals_share", sql("""SELECT round(avg(CASE WHEN abs(lat * 1000000 - round(lat * 1000000)) > 1e-4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share, count(*) AS n
    FROM points""", "points"))
def p16(d):
    return rounded(prep.decimals_share(d.points()), share=6)


# ------------------------------------------------------------------ D
@query("D1_split_by_time", sql("SELECT traj_id, user_id, t_start, t_end, n_points, split FROM trips", "trips"))
def d1(d):
    return splits.split_by_time(d.points())


@query("D2_split_by_user", sql(f"""SELECT user_id, CASE WHEN r <= round_even(0.8::DOUBLE*n, 0) THEN 'train'
      WHEN r <= round_even(0.8::DOUBLE*n, 0) + round_even(0.1::DOUBLE*n, 0) THEN 'val' ELSE 'test' END AS split FROM
    (SELECT user_id, row_number() OVER (ORDER BY {sql_hex(7, 'user', 'user_id')}, user_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM points))""", "points"))
def d2(d):
    return splits.split_by_user(d.points(), seed=7)


_PRE = "SELECT p.*, CASE WHEN trip % 5 = 4 THEN 'test' ELSE 'train' END AS split FROM fixes p"


@query("D3_split_predefined", sql(f""", pre AS ({_PRE}), tr AS (SELECT traj_id, min(user_id) AS user_id, min(t) AS t_start, min(split) AS split FROM pre GROUP BY traj_id),
    n AS (SELECT count(*) AS n FROM tr WHERE split = 'train')
    SELECT traj_id, user_id, t_start, CASE WHEN split = 'train' AND r <= greatest(1, round_even(0.1::DOUBLE * n.n, 0)) THEN 'val' ELSE split END AS split
    FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY t_start DESC, traj_id DESC) AS r FROM tr), n""", "fixes"))
def d3(d):
    p = d.fixes().withColumn("split", F.when(F.col("trip") % 5 == 4, "test").otherwise("train"))
    return splits.split_predefined(p, "time", 0.1)


@query("D4_spatial_grid", sql(f"""SELECT p.traj_id, p.t, {sql_cell('p.lat', 'p.lon')} AS cell FROM points p, grid g""", "points", "grid"))
def d4(d):
    return d.points().select("traj_id", "t", d.grid().cell(F.col("lat"), F.col("lon")).alias("cell"))


_HEX = {"hx": (["points"], """SELECT traj_id, t, lat, lon,
      (sqrt(3.0::DOUBLE)/3.0*((lon - 12.52::DOUBLE) * 0.017453292519943295::DOUBLE * 6371008.8::DOUBLE * cos(radians(55.62::DOUBLE))) - (lat - 55.62::DOUBLE) * 0.017453292519943295::DOUBLE * 6371008.8::DOUBLE/3.0)/600.0::DOUBLE AS q,
      (2.0::DOUBLE/3.0*((lat - 55.62::DOUBLE) * 0.017453292519943295::DOUBLE * 6371008.8::DOUBLE))/600.0::DOUBLE AS r FROM points"""),
        "hc": (["hx"], """SELECT *, CASE WHEN dq > dr AND dq > ds THEN -nr - ns ELSE nq END AS hq,
              CASE WHEN dq > dr AND dq > ds THEN nr WHEN dr > ds THEN -nq - ns ELSE nr END AS hr FROM
             (SELECT *, abs(nq - q) AS dq, abs(nr - r) AS dr, abs(ns + q + r) AS ds FROM
              (SELECT *, floor(q + 0.5) AS nq, floor(r + 0.5) AS nr, floor(-q - r + 0.5) AS ns FROM hx))""")}


@query("D5_hex_vocabulary", sql("""SELECT CAST(row_number() OVER (ORDER BY hq, hr) - 1 AS BIGINT) AS cell, CAST(hq AS BIGINT) AS q, CAST(hr AS BIGINT) AS r
    FROM (SELECT DISTINCT hq, hr FROM hc)""", "hc", extra=_HEX))
def d5(d):
    return G.hex_vocabulary(d.points(), 55.62, 12.52, 600.0).select("cell", "q", "r")


_SNAP = {
    "voc": (["stays"], "SELECT cell, 3 + row_number() OVER (ORDER BY cell) AS token FROM (SELECT DISTINCT cell FROM stays WHERE split = 'train')"),
    "cen": (["voc", "grid"], """SELECT token, g.x0 + ((cell % CAST(g.nx AS BIGINT)) + 0.5::DOUBLE) * 500 AS cx, g.y0 + (cell // CAST(g.nx AS BIGINT) + 0.5::DOUBLE) * 500 AS cy FROM voc, grid g"""),
    "places": (["fixes", "grid"], f"""SELECT f.event_id, f.lat, f.lon, {sql_cell('f.lat', 'f.lon')} AS cell,
         ((f.lon) - g.lon0) * g.kx AS x, ((f.lat) - g.lat0) * (0.017453292519943295::DOUBLE * 6371008.8::DOUBLE) AS y FROM fixes f, grid g"""),
    "tok": (["places", "voc", "cen"], """SELECT p.event_id, p.cell, v.token, NULL::DOUBLE AS snap_m FROM places p JOIN voc v ON v.cell = p.cell UNION ALL
        SELECT event_id, cell, arg_min(token, (d2, token)), sqrt(min(d2)) FROM
         (SELECT p.event_id, p.cell, c.token, (p.x - c.cx)*(p.x - c.cx) + (p.y - c.cy)*(p.y - c.cy) AS d2 FROM places p, cen c WHERE p.cell NOT IN (SELECT cell FROM voc)) GROUP BY event_id, cell"""),
}


def _tokens(d):
    vocab = G.region_vocabulary(d.stays().filter("split = 'train'"))
    return G.tokenize(d.fixes().select("event_id", "lat", "lon"), vocab, d.grid(), "event_id")


@query("D6_region_tokens", sql("SELECT event_id, cell, CAST(token AS BIGINT) AS token, round(snap_m, 4) AS snap_m FROM tok", "tok", extra=_SNAP))
def d6(d):
    return rounded(_tokens(d).select("event_id", "cell", "token", "snap_m"), snap_m=4)


@query("D6_snap_statistics", sql("""SELECT count(snap_m) AS n_snapped, round(max(snap_m), 4) AS max_m, round(quantile_cont(snap_m, 0.5), 4) AS median_m,
    round(quantile_cont(snap_m, 0.95), 4) AS p95_m, coalesce(quantile_cont(snap_m, 0.95) > 2000, false) AS warn FROM tok""", "tok", extra=_SNAP))
def d6b(d):
    return rounded(G.snap_statistics(_tokens(d)), max_m=4, median_m=4, p95_m=4)


_REGION = {"rg": (["points"], """SELECT la0, lo0, (greatest(h, w) / 16 * (1 + 1e-9::DOUBLE)) / 111195.0::DOUBLE AS dlat, (greatest(h, w) / 16 * (1 + 1e-9::DOUBLE)) / (111195.0::DOUBLE * k) AS dlon FROM
      (SELECT *, (la1 - la0) * 111195.0::DOUBLE AS h, (lo1 - lo0) * 111195.0::DOUBLE * k AS w FROM
       (SELECT *, cos(radians((la0 + la1) / 2)) AS k FROM (SELECT min(lat) AS la0, max(lat) AS la1, min(lon) AS lo0, max(lon) AS lo1 FROM points)))"""),
    "rid": (["rg", "fixes"], """SELECT event_id, traj_id, t, CAST(1 + least(greatest(floor((lon - lo0) / dlon), 0), 15) * 16 + least(greatest(floor((lat - la0) / dlat), 0), 15) AS BIGINT) AS region FROM fixes, rg""")}


@query("D7_region_grid_ids", sql("SELECT event_id, region FROM rid", "rid", extra=_REGION))
def d7(d):
    return G.RegionGrid.fit(d.points()).ids(d.fixes(), d.fixes()).select("event_id", "region")


@query("D7_region_vocab_capped", sql(""", tv AS (SELECT region, row_number() OVER (ORDER BY n DESC, region) AS idx FROM (SELECT region, count(*) AS n FROM rid GROUP BY region ORDER BY n DESC, region LIMIT 20))
    SELECT event_id, coalesce(idx, 21) AS region FROM rid LEFT JOIN tv ON tv.region = rid.region""", "rid", extra=_REGION))
def d7b(d):
    return G.RegionGrid.fit(d.points()).ids(d.fixes(), d.fixes(), vocabulary=20).select("event_id", "region")


@query("D9_cap_samples", sql(f"""SELECT window_id, pos, t FROM win WHERE window_id IN (SELECT window_id FROM (SELECT DISTINCT window_id FROM win WHERE split = 'test')
    ORDER BY {sql_hex(0, 'eval', 'window_id')}, window_id LIMIT 50)""", "win"))
def d9(d):
    test = d.windows().filter("split = 'test'")
    return splits.seeded_subset(test, "window_id", 50, 0, "eval").select("window_id", "pos", "t")


@query("D10_stratified_fraction", sql(f"""SELECT window_id, mode FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY {sql_hex(1, 'strat', 'window_id')}, window_id) AS r,
    count(*) OVER (PARTITION BY mode) AS n FROM (SELECT window_id, min(mode) AS mode FROM win WHERE split = 'train' GROUP BY window_id))
    WHERE r <= greatest(1, round_even(0.1::DOUBLE * n, 0))""", "win"))
def d10(d):
    labelled = d.windows().filter("split = 'train' and pos = 0").select("window_id", "mode")
    return splits.stratified_fraction(labelled, "window_id", "mode", 0.1, 1)


@query("D11_split_overlap", sql(""", tr AS (SELECT DISTINCT cell FROM stays WHERE split = 'train'), te AS (SELECT * FROM stays WHERE split = 'test')
    SELECT round((SELECT avg(CASE WHEN cell IN (SELECT cell FROM tr) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM te), 6) AS test_stays_in_train_cells,
      (SELECT count(*) FROM tr) AS train_cells, (SELECT count(DISTINCT cell) FROM te) AS test_cells,
      round((SELECT avg(CASE WHEN user_id IN (SELECT user_id FROM stays WHERE split = 'train') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM (SELECT DISTINCT user_id FROM te)), 6) AS test_users_in_train,
      (SELECT round(quantile_cont(m, 0.5), 4) FROM dd) AS median_snap_m, (SELECT round(quantile_cont(m, 0.95), 4) FROM dd) AS p95_snap_m""",
    "stays", "dd", extra={"dd": (["stays", "grid"], """SELECT sqrt(min((x - cx)*(x - cx) + (y - cy)*(y - cy))) AS m FROM
       (SELECT s.user_id, s.t_arrive, (s.lon - g.lon0) * g.kx AS x, (s.lat - g.lat0) * (0.017453292519943295::DOUBLE * 6371008.8::DOUBLE) AS y,
          g.x0 + ((c.cell % CAST(g.nx AS BIGINT)) + 0.5::DOUBLE) * 500 AS cx, g.y0 + (c.cell // CAST(g.nx AS BIGINT) + 0.5::DOUBLE) * 500 AS cy
        FROM stays s, grid g, (SELECT DISTINCT cell FROM stays WHERE split = 'train') c
        WHERE s.split = 'test' AND s.cell NOT IN (SELECT cell FROM stays WHERE split = 'train')) GROUP BY user_id, t_arrive""")}))
def d11(d):
    return rounded(info.split_overlap(d.stays(), d.grid()), test_stays_in_train_cells=6, test_users_in_train=6, median_snap_m=4, p95_snap_m=4)


_VIEW = {"window_length": LENGTH, "max_gap_s": 300, "staypoint_method": "trips", "visit_context": 5}
_VIEW_HEX = "md5('" + "|".join(f"{k}={_VIEW[k]}" for k in sorted(_VIEW)) + "')"


@query("D13_split_fingerprint", sql(f"""SELECT split, xor(bit_xor(CAST('0x' || substr(md5(traj_id), 1, 15) AS BIGINT)), CAST('0x' || substr({_VIEW_HEX}, 1, 15) AS BIGINT)) AS digest_a,
    xor(bit_xor(CAST('0x' || substr(md5(traj_id), 16, 15) AS BIGINT)), CAST('0x' || substr({_VIEW_HEX}, 16, 15) AS BIGINT)) AS digest_b, count(*) AS n_trips FROM trips GROUP BY split""", "trips"))
def d13(d):
    return splits.fingerprint(d.trips(), **_VIEW)


@query("D14_split_view", sql(f"""SELECT window_id, pos, t, 'test' AS split FROM win WHERE window_id IN (SELECT window_id FROM (SELECT DISTINCT window_id FROM win WHERE split = 'train')
    ORDER BY {sql_hex(0, 'eval', 'window_id')}, window_id LIMIT 100)""", "win"))
def d14(d):
    return info.split_view(d.windows(), "train", "window_id", 100).select("window_id", "pos", "t", "split")


@query("D15_pick_windows", sql(f""", x AS (SELECT window_id, min(user_id) AS user_id, sqrt(pow((max(lat)-min(lat))*111195.0::DOUBLE, 2) + pow((max(lon)-min(lon))*111195.0::DOUBLE*cos(radians(avg(lat))), 2)) AS e
      FROM win WHERE split = 'test' GROUP BY window_id), h AS (SELECT *, {sql_hex(5, 'pick', 'window_id')} AS hx FROM x WHERE e >= (SELECT quantile_cont(e, 0.5) FROM x)),
     o AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY hx, window_id) = 1 THEN 0 ELSE 1 END AS sec FROM h)
     SELECT window_id, user_id, round(e, 4) AS extent_m FROM o ORDER BY sec, hx, window_id LIMIT 12""", "win"))
def d15(d):
    return rounded(splits.pick_windows(d.windows().filter("split = 'test'"), 12, 5), extent_m=4)


# ------------------------------------------------------------------ V
@query("V1_make_windows", sql("SELECT window_id, user_id, traj_id, pos, t, lat, lon, mode, split FROM win", "win"))
def v1(d):
    w = views.make_windows(d.points(), 8, 8, 300.0)
    return w.join(d.trips().select("traj_id", "split"), "traj_id")


@query("V1_make_windows_overlapping", sql("""SELECT concat(traj_id, '#', CAST(seg AS VARCHAR), '#', CAST(k AS VARCHAR)) AS window_id, CAST(p - 2 * k AS BIGINT) AS pos, t
    FROM segs, range(0, 3) r(k) WHERE p >= 2 * k AND p < 2 * k + 4 AND 2 * k + 4 <= seg_n""", "segs"))
def v1b(d):
    return views.make_windows(d.points(), 4, 2, 300.0).select("window_id", "pos", "t")


_ANCHOR = {
    "u": (["points"], "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, traj_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM points"),
    "jb": (["u"], f"""SELECT a.user_id, a.i, coalesce(min(CASE WHEN {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} > 200 THEN b.i END), min(a.n)) AS j
        FROM u a LEFT JOIN u b ON b.user_id = a.user_id AND b.i > a.i GROUP BY a.user_id, a.i"""),
    "st": (["u", "jb"], """SELECT a.user_id, a.i, jb.j, (b.t - a.t >= 1200) AS stay, a.t AS t_arrive, b.t AS t_leave, a.traj_id FROM jb
        JOIN u a ON a.user_id = jb.user_id AND a.i = jb.i JOIN u b ON b.user_id = jb.user_id AND b.i = jb.j - 1"""),
    "walk": (["st"], """SELECT user_id, 0::BIGINT AS i FROM st WHERE i = 0 UNION ALL SELECT w.user_id, CASE WHEN st.stay THEN st.j ELSE st.i + 1 END
        FROM walk w JOIN st ON st.user_id = w.user_id AND st.i = w.i"""),
}


@query("V2_staypoints_points", sql("""SELECT s.user_id, s.traj_id, round(avg(u.lat), 7) AS lat, round(avg(u.lon), 7) AS lon, s.t_arrive, s.t_leave FROM st s
    JOIN (SELECT DISTINCT user_id, i FROM walk) w ON w.user_id = s.user_id AND w.i = s.i JOIN u ON u.user_id = s.user_id AND u.i >= s.i AND u.i < s.j
    WHERE s.stay GROUP BY ALL""", "walk", extra=_ANCHOR))
def v2(d):
    return rounded(views.staypoints_from_fixes(d.points(), 200.0, 1200.0), lat=7, lon=7)


@query("V3_staypoints_trips", sql("SELECT user_id, traj_id, round(lat, 8) AS lat, round(lon, 8) AS lon, t_arrive, t_leave FROM stays", "stays"))
def v3(d):
    return rounded(views.staypoints_from_trips(d.points()), lat=8, lon=8)


@query("V4_visit_sequences", sql("""SELECT c.sample_id, c.user_id, c.split, c.k, c.cell AS ctx_cell, c.t_arrive AS ctx_t_arrive, c.t_leave AS ctx_t_leave, c.in_split,
      t.cell AS tgt_cell, t.travel_s, t.duration_s FROM ctx c JOIN tgt t ON t.sample_id = c.sample_id""", "ctx", "tgt"))
def v4(d):
    v = views.visit_sequences(d.stays(), CONTEXT, 1)
    return v.select("sample_id", "user_id", "split", F.posexplode("ctx").alias("p", "c"), "tgt").select(
        "sample_id", "user_id", "split", (F.col("p") + 1).cast("bigint").alias("k"), F.col("c.cell").alias("ctx_cell"),
        F.col("c.t_arrive").alias("ctx_t_arrive"), F.col("c.t_leave").alias("ctx_t_leave"), "c.in_split",
        F.col("tgt.cell").alias("tgt_cell"), "tgt.travel_s", "tgt.duration_s")


@query("V5_pair_windows_with_visits", sql("""SELECT window_id, r AS pos, t_arrive, t_leave FROM
    (SELECT w.window_id, s.t_arrive, s.t_leave, row_number() OVER (PARTITION BY w.window_id ORDER BY s.t_leave, s.traj_id) - 1 AS r,
       row_number() OVER (PARTITION BY w.window_id ORDER BY s.t_leave DESC, s.traj_id DESC) AS back, count(*) OVER (PARTITION BY w.window_id) AS n FROM
      (SELECT window_id, min(user_id) AS user_id, min(t) AS start FROM win GROUP BY window_id) w JOIN stays s ON s.user_id = w.user_id AND s.t_leave <= w.start)
    WHERE back <= 3""".replace("SELECT window_id, r AS pos", "SELECT window_id, CAST(r - greatest(n - 3, 0) AS BIGINT) AS pos"), "win", "stays"))
def v5(d):
    v = views.pair_windows_with_visits(d.windows(), d.stays(), 3)
    return v.select("window_id", F.posexplode("visits").alias("p", "v")).filter("v is not null").select(
        "window_id", F.col("p").cast("bigint").alias("pos"), "v.t_arrive", "v.t_leave")


@query("V6_long_instances", sql(""", g AS (SELECT user_id, count(*) AS n FROM stays GROUP BY user_id HAVING count(*) >= 2),
    s AS (SELECT g.user_id, g.n, k * 2 AS start FROM g, range(0, 100) r(k) WHERE k * 2 < greatest(n - 4, 0) OR k = 0),
    i AS (SELECT *, least(start + 3, n - 1) AS e, 4 - (least(start + 3, n - 1) - start + 1) AS pad FROM s)
    SELECT user_id, CAST(start AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", CAST(pad AS BIGINT) AS pad FROM i WHERE EXISTS (SELECT 1 FROM vnum v WHERE v.user_id = i.user_id AND v.split = 'test'
      AND v.idx >= CASE WHEN i.pad > 0 THEN i.start ELSE i.start + 1 END AND v.idx <= i.e)""", "stays", "vnum"))
def v6(d):
    return views.long_instances(d.stays(), "test", 4, 2)


@query("V7_trajectories", sql("""SELECT user_id, traj_id, seg, count(*) AS n, min(t) AS t0, max(t) AS t1, round(sum(lat), 6) AS lat_sum FROM segs GROUP BY ALL HAVING count(*) >= 3""", "segs"))
def v7(d):
    t = views.trajectories(d.points(), 300.0, 3)
    total = F.aggregate("pts", F.lit(0.0), lambda a, p: a + p["lat"])
    return t.select("user_id", "traj_id", "seg", F.size("pts").cast("bigint").alias("n"), F.col("pts")[0]["t"].alias("t0"),
                    F.element_at("pts", -1)["t"].alias("t1"), F.round(total, 6).alias("lat_sum"))


@query("V8_visits_as_windows", sql("""SELECT concat('vctx:', split, ':', sample_id) AS window_id, user_id, CAST(k - 1 AS BIGINT) AS pos, t_arrive AS t, round(lat, 8) AS lat, round(lon, 8) AS lon FROM ctx""", "ctx"))
def v8(d):
    return rounded(views.visits_as_windows(d.visits()), lat=8, lon=8)


@query("V9_hide_targets", sql("""SELECT sample_id, CAST(NULL AS DOUBLE) AS travel_s, round(lat, 8) AS tgt_lat, cell AS tgt_cell, CAST(NULL AS DOUBLE) AS t_arrive FROM tgt""", "tgt"))
def v9(d):
    h = views.hide_visit_targets(d.visits(), ("location",))
    return h.select("sample_id", "tgt.travel_s", F.round("tgt.lat", 8).alias("tgt_lat"), F.col("tgt.cell").alias("tgt_cell"), "tgt.t_arrive")


@query("V9_hide_masked", sql("SELECT window_id, pos, t, CASE WHEN pos IN (2, 3, 6) THEN NULL ELSE lat END AS lat FROM win", "win"))
def v9b(d):
    return views.hide_masked(d.windows().withColumn("hidden", F.col("pos").isin(2, 3, 6))).select("window_id", "pos", "t", "lat")


@query("V10_odd_even_views", sql("""SELECT window_id, pos, CASE WHEN pos % 2 = 1 THEN 'query' ELSE 'database' END AS side, t FROM win WHERE split = 'test'""", "win"))
def v10(d):
    odd, even = views.odd_even_views(d.windows().filter("split = 'test'"))
    both = odd.withColumn("side", F.lit("query")).unionByName(even.withColumn("side", F.lit("database")))
    return both.select("window_id", "pos", "side", "t")
