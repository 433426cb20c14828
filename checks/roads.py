"""Sources, proximity joins, road networks and map matching (S, J, N, P12, D8, T8)."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wayspark.operators import grid as G, matching, prep, proximity, resample, roads, splits, views
from wayspark.session import work_dir
from wayspark.sources import context, datasets, matches, results, tables

from .common import longs, rounded
from .core import _PRE, _REGION
from .inputs import Inputs, hav, sql, sql_hex

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


def _folder(d, name):
    """A fresh folder for files this query writes and reads back."""
    return f"{work_dir(d.spark)}/files/{name}-{uuid.uuid4().hex[:8]}"


# ------------------------------------------------------------------ S
@query("S1_read_points_csv", sql("SELECT user_id, concat(user_id, ':', traj_id) AS traj_id, t, lat, lon, mode FROM points WHERE mode <> 'walk'", "points"))
def s1(d):
    path = _folder(d, "points") + ".csv"
    p = d.points().select(F.col("user_id").alias("uid"), F.col("traj_id").alias("trip"), _utc_text("t").alias("when"), "lat", F.col("lon").alias("lng"), "mode")
    p.write.option("header", True).csv(path)
    return tables.read_points(d.spark, path, columns={"user_id": "uid", "traj_id": "trip", "lon": "lng"}, time_column="when", where="mode <> 'walk'")


def _utc_text(column):
    """Clock text of unix seconds, whatever the session time zone."""
    s = F.col(column).cast("bigint")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(s / 86400).cast("int"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    rest = s % 86400
    return F.concat(day.cast("string"), F.lit(" "), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest / 60) % 60), F.lit(":"), two(rest % 60))


@query("S1_read_points_presplit", sql(f"""SELECT user_id, concat(user_id, ':', traj_id) AS traj_id, t, CASE WHEN trip % 5 = 4 THEN 'test' ELSE 'train' END AS split FROM fixes""", "fixes"))
def s1b(d):
    base = _folder(d, "presplit")
    p = d.fixes().select("user_id", "traj_id", "t", "lat", "lon", "trip")
    p.filter("trip % 5 <> 4").write.parquet(base + "/train")
    p.filter("trip % 5 = 4").write.parquet(base + "/test")
    return tables.read_points(d.spark, train_path=base + "/train", test_path=base + "/test").select("user_id", "traj_id", "t", "split")


def _shared(d):
    """Every trip in train; trips of number 2 also, wholly, in test."""
    p = d.fixes().select("user_id", "traj_id", "t", "lat", "lon", "trip")
    return p.withColumn("split", F.lit("train")).unionByName(p.filter("trip = 2").withColumn("split", F.lit("test"))) \
        .unionByName(p.filter("trip = 3").withColumns({"split": F.lit("val"), "t": F.col("t") + 7200.0})).drop("trip")


_SH = {"sh": (["fixes"], "SELECT user_id, traj_id, t, 'train' AS split FROM fixes UNION ALL SELECT user_id, traj_id, t, 'test' FROM fixes WHERE trip = 2 UNION ALL SELECT user_id, traj_id, t + 7200, 'val' FROM fixes WHERE trip = 3")}


@query("S2_drop_from_eval", sql("SELECT traj_id, t, split FROM sh WHERE split = 'train' OR traj_id NOT IN (SELECT traj_id FROM sh GROUP BY traj_id HAVING count(DISTINCT split) > 1)", "sh", extra=_SH))
def s2(d):
    return splits.resolve_overlap(_shared(d), "drop_from_eval").select("traj_id", "t", "split")


@query("S2_separate", sql("SELECT concat(split, '/', traj_id) AS traj_id, t, split FROM sh", "sh", extra=_SH))
def s2b(d):
    return splits.resolve_overlap(_shared(d), "separate").select("traj_id", "t", "split")


@query("S3_overlap_report", sql(""", s AS (SELECT traj_id, split, min(t) AS lo, max(t) AS hi, count(*) AS n FROM sh GROUP BY ALL), j AS (SELECT a.traj_id, (a.lo = b.lo AND a.hi = b.hi AND a.n = b.n)::INT::DOUBLE AS same, (a.lo <= b.hi AND b.lo <= a.hi)::INT::DOUBLE AS meets
     FROM s a JOIN s b ON a.traj_id = b.traj_id AND a.split = 'train' AND b.split <> 'train'), h AS (SELECT (max(t) - min(t)) / 3600.0::DOUBLE AS hours FROM sh GROUP BY traj_id)
   SELECT (SELECT count(*) FROM j) AS n_shared, (SELECT round(avg(same), 6) FROM j) AS share_same, (SELECT round(avg(meets), 6) FROM j) AS share_overlap, (SELECT round(quantile_cont(hours, 0.5), 6) FROM h) AS median_h,
     (SELECT round(quantile_cont(hours, 0.99), 6) FROM h) AS p99_h, (SELECT CASE WHEN avg(same) > 0.9 THEN 'same trips' WHEN avg(meets) < 0.1 THEN 'ids reused' ELSE 'split by point' END FROM j) AS diagnosis""", "sh", extra=_SH))
def s3(d):
    return rounded(splits.overlap_report(_shared(d)), share_same=6, share_overlap=6, median_h=6, p99_h=6)


@query("S4_read_geolife", sql("""SELECT user_id, concat(user_id, '_', replace(traj_id, ':', '-')) AS traj_id, t, round(lat, 6) AS lat, round(lon, 6) AS lon, CASE WHEN f.t <= s.e THEN s.mode END AS mode FROM points f
    JOIN (SELECT traj_id, max(t) - 60 AS e, min(CASE mode WHEN 'bus' THEN 'train' ELSE mode END) AS mode FROM points GROUP BY traj_id) s USING (traj_id)""", "points"))
def s4(d):
    root = _folder(d, "geolife")
    p = d.points()
    line = F.concat_ws(",", F.format_string("%.6f", "lat"), F.format_string("%.6f", "lon"), F.lit("0"), F.lit("100"), F.lit("45000.0"), F.substring(_utc_text("t"), 1, 10), F.substring(_utc_text("t"), 12, 8))
    # one folder per user and file per trip in the layout the reader expects, written by Spark
    rows = p.select(F.col("user_id").alias("u"), F.translate("traj_id", ":", "-").alias("trip"), F.col("t"), line.alias("value"))
    labels = p.groupBy("user_id", "traj_id").agg(F.min("t").alias("a"), (F.max("t") - 60).alias("b"), F.min("mode").alias("m")) \
        .select("user_id", F.concat_ws("\t", F.translate(_utc_text("a"), "-", "/"), F.translate(_utc_text("b"), "-", "/"), F.when(F.col("m") == "bus", "subway").otherwise(F.col("m"))).alias("value"))
    _write_tree(rows, labels, root)
    return rounded(datasets.read_geolife(d.spark, root, max_speed_mps=None), lat=6, lon=6)


def _file_writer(root, place, header):
    """Task code that writes one text file per row (name, lines) below ``root`` on any file system."""
    import pyarrow as pa
    from pyarrow import fs

    def write(batches):
        store, base = fs.FileSystem.from_uri(root)
        made = set()
        for b in batches:
            for name, lines in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                path = f"{base}/{place(name)}"
                folder = path.rsplit("/", 1)[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(path) as out:
                    out.write(("\n".join([*header, *lines]) + "\n").encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])
    return lambda files: files.mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


def _in_order(rows, key):
    """(key, lines) of small files: the trips of the checks have at most eight fixes."""
    return rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "value"))), lambda s: s["value"]).alias("lines"))


def _write_tree(rows, labels, root):
    trips = rows.select(F.concat_ws("/", "u", F.lit("Trajectory"), "trip").alias("file"), "t", "value")
    _file_writer(root, lambda n: n + ".plt", ("Some trajectory", "WGS 84", "Altitude is in Feet", "Reserved 3", "0,2,255,My Track,0,0,2,8421376", "0"))(_in_order(trips, "file"))
    _file_writer(root, lambda n: n + "/labels.txt", ("Start Time\tEnd Time\tTransportation Mode",))(
        labels.groupBy("user_id").agg(F.collect_list("value").alias("lines")))


@query("S5_read_worldtrace", sql("SELECT replace(traj_id, ':', '-') AS user_id, replace(traj_id, ':', '-') AS traj_id, t, lat, lon FROM points", "points"))
def s5(d):
    root = _folder(d, "traces")
    rows = d.points().select(F.translate("traj_id", ":", "-").alias("trip"), F.col("t"), F.concat_ws(",", _utc_text("t"), F.col("lat").cast("string"), F.col("lon").cast("string")).alias("value"))
    _file_writer(root, lambda n: n + ".csv", ("time,latitude,longitude",))(_in_order(rows, "trip"))
    return datasets.read_worldtrace(d.spark, root)


@query("S6_read_porto", sql("""SELECT user_id, traj_id, min(t) OVER (PARTITION BY traj_id) + 15 * (row_number() OVER (PARTITION BY traj_id ORDER BY t) - 1) AS t, round(lat, 6) AS lat, round(lon, 6) AS lon FROM fixes WHERE trip % 7 <> 3""", "fixes"))
def s6(d):
    path = _folder(d, "porto") + ".csv"
    pair = F.concat(F.lit("["), F.format_string("%.6f", "lon"), F.lit(","), F.format_string("%.6f", "lat"), F.lit("]"))
    p = d.fixes().groupBy("user_id", "traj_id", "trip").agg(F.min("t").alias("t0"), F.sort_array(F.collect_list(F.struct("t", pair.alias("p")))).alias("ps"))
    p.select(F.col("traj_id").alias("TRIP_ID"), F.lit("A").alias("CALL_TYPE"), F.col("user_id").alias("TAXI_ID"), F.col("t0").cast("bigint").alias("TIMESTAMP"),
             F.when(F.col("trip") % 7 == 3, "True").otherwise("False").alias("MISSING_DATA"), F.concat(F.lit("["), F.concat_ws(",", "ps.p"), F.lit("]")).alias("POLYLINE")) \
        .write.option("header", True).option("escape", '"').csv(path)
    return rounded(datasets.read_porto(d.spark, path), lat=6, lon=6)


@query("S7_read_trip_tables", sql("SELECT user_id, traj_id, t, lat, lon FROM points", "points"))
def s7(d):
    base = _folder(d, "trips")
    d.points().select(F.col("traj_id").alias("trip"), F.col("t").alias("time"), F.col("lon").alias("lng"), "lat").write.parquet(base + "/trips")
    d.points().select(F.col("traj_id").alias("trip"), F.col("user_id").alias("driver")).distinct().write.parquet(base + "/info")
    return datasets.read_trip_tables(d.spark, base + "/trips", base + "/info")


_GEO = "CASE WHEN event_id % 3 = 0 THEN concat('amenity=', mode) WHEN event_id % 3 = 1 THEN concat('shop=', mode) ELSE 'other' END"


@query("S8_read_context_features", sql(f"""SELECT round(lat + CASE WHEN event_id % 2 = 0 THEN 0 ELSE 0.0005::DOUBLE END, 7) AS lat, round(lon, 7) AS lon, {_GEO} AS category FROM fixes""", "fixes"))
def s8(d):
    path = _folder(d, "features") + ".json"
    e = F.col("event_id")
    props = F.when(e % 3 == 0, F.create_map(F.lit("amenity"), F.col("mode"), F.lit("shop"), F.lit("x"))).when(e % 3 == 1, F.create_map(F.lit("shop"), F.col("mode"))) \
        .otherwise(F.create_map(F.lit("name"), F.col("mode")))
    num = lambda c: F.format_string("%.9f", c)
    point = F.concat(F.lit("["), num("lon"), F.lit(","), num("lat"), F.lit("]"))
    other = F.concat(F.lit("["), num("lon"), F.lit(","), F.format_string("%.9f", F.col("lat") + 0.001), F.lit("]"))
    line = F.concat(F.lit("["), point, F.lit(","), other, F.lit("]"))
    text = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(props), F.lit(',"geometry":{"type":"'), F.when(e % 2 == 0, "Point").otherwise("LineString"),
                    F.lit('","coordinates":'), F.when(e % 2 == 0, point).otherwise(line), F.lit("}}"))
    d.fixes().select(text.alias("value")).write.text(path)
    return rounded(context.read_features(d.spark, path, one_per_line=True), lat=7, lon=7)


@query("P12_line_sample_points", sql(f""", v AS (SELECT traj_id, t, lat, lon, {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS d, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM points WINDOW w AS (PARTITION BY traj_id ORDER BY t)),
    c AS (SELECT *, sum(d) OVER (PARTITION BY traj_id ORDER BY t) AS hi, sum(d) OVER (PARTITION BY traj_id) AS tot FROM v), z AS (SELECT *, greatest(ceil(tot / 250.0::DOUBLE), 1) AS n FROM c WHERE tot > 0)
    SELECT z.traj_id, CAST(k AS BIGINT) AS k, round(la + ((k + 0.5::DOUBLE) * tot / n - (hi - d)) / d * (lat - la), 7) AS lat, round(lo + ((k + 0.5::DOUBLE) * tot / n - (hi - d)) / d * (lon - lo), 7) AS lon FROM z, range(0, 400) r(k)
    WHERE k < n AND d > 0 AND (k + 0.5::DOUBLE) * tot / n >= hi - d AND (k + 0.5::DOUBLE) * tot / n < hi""", "points"))
def p12(d):
    v = d.points().select("traj_id", F.col("t").alias("pos"), "lat", "lon")
    long = v.groupBy("traj_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rounded(context.sample_lines(v.join(long.select("traj_id"), "traj_id", "left_semi"), "traj_id", 250.0), lat=7, lon=7)


@query("S9_write_read_results", sql("SELECT model, task, metric, round(v, 6) AS value FROM (SELECT concat('m', CAST(user_id % 3 AS VARCHAR)) AS model, concat('mode@', event_type) AS task, 'accuracy' AS metric, avg(value) AS v FROM events GROUP BY user_id % 3, event_type)"))
def s9(d):
    path = _folder(d, "results")
    r = d.table("events").groupBy(F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), F.concat(F.lit("mode@"), "event_type").alias("task")) \
        .agg(F.avg("value").alias("value")).withColumns({"metric": F.lit("accuracy"), "flags": F.array().cast("array<string>")})
    results.write_results(r.withColumn("value", F.lit(0.0)), path)
    results.write_results(r, path)                                   # a second run replaces the first
    good, _ = results.read_results(d.spark, path)
    return rounded(good.select("model", "task", "metric", "value"), value=6)


def _matched(d):
    """Segments of fixes: a number per 300 m cell, one in eleven unmatched."""
    g = G.SquareGrid.fit(d.points(), 300.0)
    seg = F.when(F.col("event_id") % 11 == 0, F.lit(-1)).otherwise(g.cell(F.col("lat"), F.col("lon")))
    return d.fixes().select("traj_id", "t", seg.cast("bigint").alias("seg"), "event_id")


@query("S10_match_table_io", sql("SELECT traj_id, t, CASE WHEN event_id % 11 = 0 THEN -1 ELSE i END AS seg FROM fixes", "fixes"))
def s10(d):
    path = _folder(d, "matches") + ".csv"
    m = d.fixes().select("traj_id", "t", F.when(F.col("event_id") % 11 == 0, -1).otherwise(F.col("i")).alias("seg"))
    matches.write_matches(m, path)
    return matches.read_matches(d.spark, path)


@query("S10_external_matcher_exchange", sql("""SELECT p.traj_id, p.t, CASE WHEN id % 9 = 0 THEN -1 ELSE (r * 3) END AS seg FROM (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY t) AS r FROM points) p
    JOIN (SELECT traj_id, row_number() OVER (ORDER BY traj_id) - 1 AS id FROM (SELECT DISTINCT traj_id FROM points)) n ON n.traj_id = p.traj_id""", "points"))
def s10b(d):
    base = _folder(d, "exchange")
    ids = matches.export_points(d.points(), base + "/points.csv")
    # the external result: one edge (its position) per fix, one trip in nine with an edge missing
    back = d.spark.read.option("sep", ";").option("header", True).csv(base + "/points.csv").withColumn("id", F.col("id").cast("bigint"))
    n = back.groupBy("id").agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.when(F.col("id") % 9 == 0, F.col("n") - 1).otherwise(F.col("n")))
    path = F.when(F.col("n") > 0, F.concat_ws(",", F.transform(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), lambda x: x.cast("string")))).otherwise("")
    n.select("id", path.alias("opath")).write.option("sep", ";").option("header", True).csv(base + "/result.csv")
    edges = d.spark.range(1, 100).select(F.col("id").alias("edge"), (F.col("id") * 3).alias("seg"))
    return matches.import_paths(d.points(), base + "/result.csv", edges)


@query("S12_archive_subset", sql(f"""SELECT traj_id, t FROM points WHERE traj_id IN (SELECT traj_id FROM (SELECT traj_id FROM points GROUP BY traj_id HAVING count(*) >= 6) ORDER BY {sql_hex(0, 'traj', 'traj_id')}, traj_id LIMIT 80)""", "points"))
def s12(d):
    return datasets.archive_subset(d.points(), 80, _folder(d, "subset"), 6).select("traj_id", "t")


# ------------------------------------------------------------------ J
@query("J1_points_with_segments", sql("SELECT f.event_id, CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN -1 ELSE i END AS seg FROM fixes f", "fixes"))
def j1(d):
    f = d.fixes()
    m = f.filter("event_id % 13 <> 0").select("traj_id", (F.col("t") + 1e-7).alias("t"), F.when(F.col("event_id") % 11 == 0, -1).otherwise(F.col("i")).alias("seg"))
    return proximity.with_segments(f, m).select("event_id", "seg")


@query("J2_semi_anti", sql("SELECT traj_id, user_id IN (SELECT user_id FROM trips WHERE split = 'train') AS user_in_train FROM trips WHERE split = 'test'", "trips"))
def j2(d):
    t = d.trips()
    users = t.filter("split = 'train'").select("user_id").distinct()
    test = t.filter("split = 'test'").select("traj_id", "user_id")
    known = test.join(users, "user_id", "left_semi").withColumn("user_in_train", F.lit(True))
    return known.unionByName(test.join(users, "user_id", "left_anti").withColumn("user_in_train", F.lit(False))).select("traj_id", "user_in_train")


@query("J3_asof_last_stay", sql("""SELECT p.traj_id, p.t_start, max(s.t_leave) AS last_leave FROM trips p LEFT JOIN stays s ON s.user_id = p.user_id AND s.t_leave <= p.t_start GROUP BY p.traj_id, p.t_start""", "trips", "stays"))
def j3(d):
    left = d.trips().select("user_id", F.col("t_start").alias("_at"), F.lit(1).alias("side"), "traj_id", F.lit(None).cast("double").alias("leave"))
    right = d.stays().select("user_id", F.col("t_leave").alias("_at"), F.lit(0).alias("side"), F.lit(None).cast("string").alias("traj_id"), F.col("t_leave").alias("leave"))
    r = prep.as_of(left.unionByName(right), ["_at", "side", "traj_id"], "leave", "last_leave")
    return r.filter("side = 1").select("traj_id", F.col("_at").alias("t_start"), "last_leave")


_XY = "(({lon}) - 12.52::DOUBLE) * 0.017453292519943295::DOUBLE * 6371008.8::DOUBLE * cos(radians(55.62::DOUBLE))", "(({lat}) - 55.62::DOUBLE) * 0.017453292519943295::DOUBLE * 6371008.8::DOUBLE"


@query("J4_nearest_place", sql(f"""SELECT event_id, round(sqrt(min(pow(px - sx, 2) + pow(py - sy, 2))), 4) AS dist_m FROM (SELECT f.event_id, {_XY[0].format(lon='f.lon')} AS px, {_XY[1].format(lat='f.lat')} AS py, {_XY[0].format(lon='s.lon')} AS sx, {_XY[1].format(lat='s.lat')} AS sy
    FROM fixes f, (SELECT DISTINCT lat, lon FROM stays) s) GROUP BY event_id""", "fixes", "stays"))
def j4(d):
    return rounded(G.nearest(d.fixes().select("event_id", "lat", "lon"), d.stays().select("traj_id", "lat", "lon"), "event_id", "traj_id", 55.62, 12.52).select("event_id", "dist_m"), dist_m=4)


# every fix within 150 m of every fix; the box in degrees is wider than that
_NEAR = {"nr": (["fixes"], f"""SELECT f.event_id, q.mode AS category, q.i AS place, q.trip FROM fixes f JOIN fixes q ON q.lat BETWEEN f.lat - 0.0014 AND f.lat + 0.0014 AND q.lon BETWEEN f.lon - 0.0025 AND f.lon + 0.0025
    WHERE {hav('f.lat', 'f.lon', 'q.lat', 'q.lon')} <= 150""")}


def _near_all(d):
    return proximity.within_radius(d.fixes(), d.fixes().select("lat", "lon"), "event_id", 150.0, 55.62, 12.52)


@query("J5_features_within_radius", sql("SELECT event_id, count(*) AS n_near FROM nr GROUP BY event_id", "nr", extra=_NEAR))
def j5(d):
    return longs(_near_all(d).select("event_id", "n_near"), "n_near")


@query("J5_radius_summary", sql("SELECT round(avg((n > 0)::INT::DOUBLE), 6) AS share_any, round(avg(n), 6) AS mean_near FROM (SELECT count(*) AS n FROM nr GROUP BY event_id)", "nr", extra=_NEAR))
def j5b(d):
    return rounded(proximity.coverage_summary(_near_all(d)), share_any=6, mean_near=6)


@query("J5_category_counts", sql("SELECT event_id, category, count(*) AS n_near FROM nr GROUP BY event_id, category", "nr", extra=_NEAR))
def j5c(d):
    poi = d.fixes().select("lat", "lon", F.col("mode").alias("category"))
    return longs(proximity.category_counts(d.fixes(), poi, "event_id", 150.0, 55.62, 12.52), "n_near")


@query("J5_mean_vector", sql("SELECT event_id, round(avg(place), 6) AS v0, round(avg(trip), 6) AS v1, round(avg(place * trip), 6) AS v2 FROM nr GROUP BY event_id", "nr", extra=_NEAR))
def j5v(d):
    vector = F.array(*[c.cast("double") for c in (F.col("i"), F.col("trip"), F.col("i") * F.col("trip"))]).alias("vector")
    m = proximity.mean_vector(d.fixes(), d.fixes().select("lat", "lon", vector), "event_id", 150.0, 55.62, 12.52)
    return rounded(m.select("event_id", *[F.col("vector")[n].alias(f"v{n}") for n in range(3)]), v0=6, v1=6, v2=6)


# ------------------------------------------------------------------ N
_WAYS = {
    "wn0": (["fixes"], """SELECT traj_id AS way, i AS seq, concat(CAST(CAST(floor(lat * 1000) AS BIGINT) AS VARCHAR), '_', CAST(CAST(floor(lon * 1000) AS BIGINT) AS VARCHAR)) AS node, mode, trip FROM fixes"""),
    "wn": (["wn0"], """SELECT way, min(seq) AS seq, node, (CAST(split_part(node, '_', 1) AS BIGINT) + 0.5::DOUBLE) / 1000 AS lat, (CAST(split_part(node, '_', 2) AS BIGINT) + 0.5::DOUBLE) / 1000 AS lon,
        CASE min(mode) WHEN 'walk' THEN 'footway' WHEN 'bike' THEN 'residential' WHEN 'bus' THEN 'primary' ELSE 'motorway' END AS highway,
        CASE min(trip) % 5 WHEN 0 THEN 'yes' WHEN 1 THEN '-1' WHEN 2 THEN 'no' END AS oneway, CASE WHEN min(trip) % 6 = 5 THEN 'roundabout' END AS junction FROM wn0 GROUP BY way, node"""),
    "dn": (["wn"], """SELECT way, CASE WHEN oneway = '-1' THEN -seq ELSE seq END AS seq, node, lat, lon, (coalesce(oneway, '') IN ('yes', '-1') OR highway = 'motorway' OR coalesce(junction, '') = 'roundabout') AND coalesce(oneway, '') <> 'no' AS oneway FROM wn WHERE highway <> 'footway'"""),
    "de": (["dn"], "SELECT * FROM (SELECT *, seq = min(seq) OVER w OR seq = max(seq) OVER w AS isend, count(*) OVER w AS n FROM dn WINDOW w AS (PARTITION BY way)) WHERE n >= 2"),
    "dc": (["de"], "SELECT d.*, NOT isend AND (SELECT sum(CASE WHEN isend THEN 2 ELSE 1 END) FROM de e WHERE e.node = d.node) >= 2 AS cut FROM de d"),
    "dp": (["dc"], "SELECT *, CAST(sum(cut::INT) OVER (PARTITION BY way ORDER BY seq) AS BIGINT) AS piece FROM dc"),
    "sr": (["dp"], "SELECT way, piece, seq, node, lat, lon, oneway FROM dp UNION ALL SELECT way, piece - 1, seq, node, lat, lon, oneway FROM dp WHERE cut"),
    "sg": (["sr"], f"""SELECT row_number() OVER (ORDER BY way, piece) - 1 AS seg_id, * FROM (SELECT way, piece, arg_min(node, seq) AS u, arg_max(node, seq) AS v, any_value(oneway) AS oneway, sum(coalesce(d, 0)) AS length_m, count(*) AS n FROM
        (SELECT *, {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS d FROM sr WINDOW w AS (PARTITION BY way, piece ORDER BY seq)) GROUP BY way, piece)"""),
    "ed": (["sg"], "SELECT a, b, min(w) + 1e-6 AS w FROM (SELECT u AS a, v AS b, length_m AS w FROM sg UNION ALL SELECT v, u, length_m FROM sg WHERE NOT oneway) GROUP BY a, b"),
}


def _way_nodes(d):
    """Every trip as a way over a lattice of nodes; class, direction and junction from its number."""
    f = d.fixes()
    node = F.concat_ws("_", F.floor(F.col("lat") * 1000).cast("string"), F.floor(F.col("lon") * 1000).cast("string"))
    w = f.groupBy(F.col("traj_id").alias("way"), node.alias("node")).agg(F.min("i").alias("seq"), F.min("mode").alias("mode"), F.min("trip").alias("trip"))
    part = lambda i: (F.split("node", "_")[i].cast("bigint") + 0.5) / 1000
    m, k = F.col("mode"), F.col("trip") % 5
    return w.select("way", "seq", "node", part(0).alias("lat"), part(1).alias("lon"),
                    F.when(m == "walk", "footway").when(m == "bike", "residential").when(m == "bus", "primary").otherwise("motorway").alias("highway"),
                    F.when(k == 0, "yes").when(k == 1, "-1").when(k == 2, "no").alias("oneway"), F.when(F.col("trip") % 6 == 5, "roundabout").alias("junction"))


@query("N1_segment_ways", sql("SELECT seg_id, way, piece, u, v, oneway, n AS n_vertices FROM sg", "sg", extra=_WAYS))
def n1(d):
    s = roads.segment_ways(_way_nodes(d)).withColumn("n_vertices", F.size("geom").cast("bigint"))
    return longs(s.select("seg_id", "way", "piece", "u", "v", "oneway", "n_vertices"), "piece")


@query("N2_segment_length_bbox", sql("""SELECT way, piece, round(length_m, 4) AS length_m FROM sg""", "sg", extra={**_WAYS, "wn": (["wn0"], _WAYS["wn"][1].replace("GROUP BY way, node", "GROUP BY way, node")),
    "dn": (["wn"], _WAYS["dn"][1] + " AND way IN (SELECT way FROM wn WHERE lat BETWEEN 55.60 AND 55.61 AND lon BETWEEN 12.50 AND 12.53)")}))
def n2(d):
    s = roads.segment_ways(_way_nodes(d), (55.60, 55.61, 12.50, 12.53))
    return longs(rounded(s.select("way", "piece", "length_m"), length_m=4), "piece")


@query("N3_directed_edges", sql("SELECT a, b, round(w, 4) AS w FROM ed", "ed", extra=_WAYS))
def n3(d):
    return rounded(roads.directed_edges(roads.segment_ways(_way_nodes(d))), w=4)


# shortest lengths by relaxation in rounds: a table of the best length of each pair, replaced where a step is shorter
_ROUTES = "rt(source, node, d) USING KEY (source, node)"


@query("N4_bounded_routes", sql("SELECT source, node, round(d, 3) AS d FROM rt", _ROUTES, extra={**_WAYS, _ROUTES: (["ed"], """SELECT DISTINCT n, n, 0.0::DOUBLE FROM (SELECT unnest([a, b]) AS n FROM ed) UNION
        SELECT r.source, e.b, min(r.d + e.w) FROM rt r JOIN ed e ON e.a = r.node LEFT JOIN recurring.rt k ON k.source = r.source AND k.node = e.b
        WHERE r.d + e.w <= 900 AND (k.d IS NULL OR r.d + e.w < k.d) GROUP BY r.source, e.b""")}))
def n4(d):
    """From every node of the edges."""
    from wayspark.session import cut_lineage
    edges = cut_lineage(roads.located_edges(roads.segment_ways(_way_nodes(d))))
    sources = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("limit_m", F.lit(900.0))
    return rounded(roads.bounded_routes(edges, sources), d=3)


def _network(d):
    """Roads for matching: one way per distinct pair of end nodes, driven in both directions."""
    w = _way_nodes(d)
    ends = w.groupBy("way").agg(F.min_by("node", "seq").alias("a"), F.max_by("node", "seq").alias("b"))
    keep = ends.filter("a <> b").groupBy("a", "b").agg(F.min("way").alias("way")).select("way")
    return d.store.view("network", lambda: roads.segment_ways(
        w.join(keep, "way", "left_semi").withColumns({"highway": F.lit("residential"), "oneway": F.lit(None).cast("string"), "junction": F.lit(None).cast("string")})))


# the network of _network with its pieces, and every road within 60 m of a position by comparing all
_NET = {
    **_WAYS,
    "dn": (["wn"], """SELECT way, seq, node, lat, lon, FALSE AS oneway FROM wn WHERE way IN (SELECT min(way) FROM (SELECT way, arg_min(node, seq) AS a, arg_max(node, seq) AS b
        FROM wn GROUP BY way) WHERE a <> b GROUP BY a, b)"""),
    "rp": (["sg"], f"""SELECT seg_id, x0, y0, x1, y1, len, coalesce(sum(len) OVER (PARTITION BY seg_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM (
        SELECT *, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS len FROM (SELECT g.seg_id, r.seq, {_XY[0].format(lon='r.lon')} AS x0, {_XY[1].format(lat='r.lat')} AS y0,
            {_XY[0].format(lon='lead(r.lon) OVER w')} AS x1, {_XY[1].format(lat='lead(r.lat) OVER w')} AS y1 FROM sr r JOIN sg g ON g.way = r.way AND g.piece = r.piece
            WINDOW w AS (PARTITION BY g.seg_id ORDER BY r.seq)) WHERE x1 IS NOT NULL)"""),
    "cr": (["rp", "fixes"], f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lat, lon ORDER BY round(dist, 6), seg_id) AS r FROM (
        SELECT lat, lon, seg_id, min(dist) AS dist, min(struct_pack(d := dist, o := off + u * len)).o AS off FROM (
            SELECT *, sqrt(pow(x - x0 - u * (x1 - x0), 2) + pow(y - y0 - u * (y1 - y0), 2)) AS dist FROM (
                SELECT *, least(greatest(((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / greatest((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0), 1e-12::DOUBLE), 0), 1) AS u
                FROM (SELECT DISTINCT lat, lon, {_XY[0].format(lon='lon')} AS x, {_XY[1].format(lat='lat')} AS y FROM fixes) f
                JOIN rp ON x BETWEEN least(x0, x1) - 61 AND greatest(x0, x1) + 61 AND y BETWEEN least(y0, y1) - 61 AND greatest(y0, y1) + 61)) WHERE dist <= 60
        GROUP BY lat, lon, seg_id)) WHERE r <= 8"""),
}


@query("J6_candidate_roads", sql("SELECT f.traj_id, f.t, c.seg_id, round(c.dist, 4) AS dist, round(c.off, 4) AS off FROM fixes f JOIN cr c ON c.lat = f.lat AND c.lon = f.lon", "cr", extra=_NET))
def j6(d):
    pieces = proximity.road_pieces(_network(d), 55.62, 12.52)
    return rounded(proximity.candidate_roads(d.points(), pieces, 60.0, 8, 55.62, 12.52).select("traj_id", "t", "seg_id", "dist", "off"), dist=4, off=4)


@query("J6_nearest_road", sql(f""", nd AS (SELECT way, arg_min(node, seq) AS a, arg_max(node, seq) AS b FROM wn GROUP BY way), kp AS (SELECT min(way) AS way FROM nd WHERE a <> b GROUP BY a, b),
    pc AS (SELECT w.way, {_XY[0].format(lon='lag(w.lon) OVER q')} AS x0, {_XY[1].format(lat='lag(w.lat) OVER q')} AS y0, {_XY[0].format(lon='w.lon')} AS x1, {_XY[1].format(lat='w.lat')} AS y1 FROM wn w JOIN kp ON kp.way = w.way WINDOW q AS (PARTITION BY w.way ORDER BY seq)),
    pd AS (SELECT DISTINCT x0, y0, x1, y1 FROM pc WHERE x0 IS NOT NULL),
    f AS (SELECT event_id, {_XY[0].format(lon='lon')} AS x, {_XY[1].format(lat='lat')} AS y FROM fixes),
    s AS (SELECT event_id, x, y, x0, y0, x1 - x0 AS dx, y1 - y0 AS dy, least(greatest(((x - x0)*(x1 - x0) + (y - y0)*(y1 - y0)) / greatest(pow(x1 - x0, 2) + pow(y1 - y0, 2), 1e-12), 0), 1) AS u FROM f, pd)
    SELECT event_id, round(m, 4) AS dist FROM (SELECT event_id, min(sqrt(pow(x - x0 - u*dx, 2) + pow(y - y0 - u*dy, 2))) AS m FROM s GROUP BY event_id) WHERE m <= 60""", "wn", "fixes", extra=_WAYS))
def j6b(d):
    pieces = proximity.road_pieces(_network(d), 55.62, 12.52)
    c = proximity.candidate_roads(d.fixes(), pieces, 60.0, 8, 55.62, 12.52).groupBy("traj_id", "t").agg(F.min("dist").alias("dist"))
    return rounded(d.fixes().select("event_id", "traj_id", "t").join(c, ["traj_id", "t"]).select("event_id", "dist"), dist=4)


def _matching(d):
    return d.store.view("matched", lambda: matching.match(d.points(), _network(d), 55.62, 12.52))


@query("N5_match_candidates", sql("""SELECT f.traj_id, f.t, c.seg_id AS seg, w.forward, round(CASE WHEN w.forward THEN c.off ELSE l.len - c.off END, 4) AS along, round(c.dist, 4) AS dist
    FROM fixes f JOIN cr c ON c.lat = f.lat AND c.lon = f.lon JOIN (SELECT seg_id, sum(len) AS len FROM rp GROUP BY seg_id) l ON l.seg_id = c.seg_id, (VALUES (TRUE), (FALSE)) w(forward)""", "cr", extra=_NET))
def n5(d):
    s = matching.match_states(d.points(), _network(d), 55.62, 12.52)
    return rounded(s.select("traj_id", "t", "seg", "forward", "along", "dist"), along=4, dist=4)


@query("N6_match_viterbi")
def n6(d):
    return matching.match(d.points(), _network(d), 55.62, 12.52)


@query("N7_match_rate", sql("""SELECT round(avg((c.lat IS NOT NULL)::INT::DOUBLE), 6) AS match_rate, count(*) AS n FROM fixes f
    LEFT JOIN (SELECT DISTINCT lat, lon FROM cr) c ON c.lat = f.lat AND c.lon = f.lon""", "cr", extra=_NET))
def n7(d):
    return rounded(matching.match_rate(_matching(d)), match_rate=6)


# ------------------------------------------------------------------ D8, T8
@query("D8_road_vocab", sql("SELECT seg, n, row_number() OVER (ORDER BY n DESC, seg) AS index FROM (SELECT seg, count(*) AS n FROM (SELECT CASE WHEN event_id % 11 = 0 THEN -1 ELSE (event_id * 7) % 50 END AS seg FROM fixes) WHERE seg >= 0 GROUP BY seg ORDER BY n DESC, seg LIMIT 40)", "fixes"))
def d8(d):
    m = d.fixes().select(F.when(F.col("event_id") % 11 == 0, -1).otherwise((F.col("event_id") * 7) % 50).alias("seg"))
    return G.road_vocabulary(m, 40).select("seg", "n", "index")


@query("T8_training_sample_table", sql(""", f AS (SELECT traj_id, t, CASE WHEN event_id % 11 = 0 THEN -1 ELSE (event_id * 7) % 50 END AS seg FROM fixes), v AS (SELECT seg, row_number() OVER (ORDER BY n DESC, seg) AS idx FROM (SELECT seg, count(*) AS n FROM f WHERE seg >= 0 GROUP BY seg)),
    c AS (SELECT count(*) AS r FROM v), o AS (SELECT f.traj_id, v.idx, min(t) AS t FROM f JOIN v ON v.seg = f.seg GROUP BY f.traj_id, v.idx), kk AS (SELECT traj_id, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY t, idx) AS s, count(*) AS n FROM o GROUP BY traj_id)
    SELECT a.traj_id, coalesce(kk.n, 0) + 2 AS n_road, concat(CAST(c.r + 4 AS VARCHAR), ',', CASE WHEN kk.s IS NULL THEN '' ELSE concat(kk.s, ',') END, CAST(c.r + 3 AS VARCHAR)) AS road FROM (SELECT DISTINCT traj_id FROM segs WHERE seg_n >= 3) a LEFT JOIN kk ON kk.traj_id = a.traj_id, c""", "fixes", "segs"))
def t8(d):
    roads_ = d.fixes().select("traj_id", "t", F.when(F.col("event_id") % 11 == 0, -1).otherwise((F.col("event_id") * 7) % 50).alias("seg"))
    vocab = G.road_vocabulary(roads_, 200_000)
    trips = views.trajectories(d.points(), 300.0, 3)
    r = d.points().agg(*[f(c).alias(f"{c}_{n}") for c in ("lat", "lon") for n, f in (("mean", F.avg), ("sd", F.stddev_pop))]).first().asDict()
    s = resample.training_samples(trips, G.RegionGrid.fit(d.points()), r, roads_, vocab)
    n = F.aggregate("road_mask", F.lit(0.0), lambda a, x: a + x).cast("int")
    return s.select("traj_id", n.cast("bigint").alias("n_road"), F.concat_ws(",", F.transform(F.slice("road", 1, n), lambda x: x.cast("string"))).alias("road"))
