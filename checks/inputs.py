"""Inputs of the checks: GPS fixes derived from ``events``, and the shared evaluation views.

The derivation exists twice: as DataFrame code for Spark and as SQL text for the comparison engine.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspark.functions import ordered
from wayspark.operators import grid as grids
from wayspark.operators import splits, views
from wayspark.session import ViewStore

# Evaluation settings used by every check.
LENGTH, MAX_GAP_S, CONTEXT, CELL_M = 8, 300.0, 3, 500.0
MIN_STAY_S, MAX_LINK_M, MAX_STAY_S = 1200.0, 500.0, 259200.0


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self.store = ViewStore(spark, self.sf_dir)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ------------------------------------------------------------------ fixes
    def _fixes(self) -> DataFrame:
        events = self.table("events").select("user_id", "event_id", "ts")
        day = F.unix_date(F.to_date("ts")).cast("bigint")
        count = ordered.over_groups("user_id", chunk=lambda: day)(
            lambda df, chunk: ordered.numbered(df, ["user_id"], ["ts", "event_id"], "rn", chunk))
        n = count(events)
        rn = F.col("rn") - 1
        trip = F.floor(rn / 8).cast("bigint")
        n = n.select("user_id", "event_id", trip.alias("trip"), (rn % 8).alias("i"))
        a = n.withColumns({
            "a0": (F.col("user_id") * 31 + F.col("trip") * 17) % 11,
            "a1": (F.col("user_id") * 31 + (F.col("trip") + 1) * 17) % 11,
            "m": (F.col("user_id") + F.col("trip")) % 4})
        m, i, e = F.col("m"), F.col("i"), F.col("event_id")
        step = F.when(m == 0, 60).when(m == 1, 30).when(m == 2, 20).otherwise(15)
        t = F.lit(1704067200) + (F.col("user_id") % 7) * 3600 + F.col("trip") * 21600 + i * step + e % 7
        part = i / F.lit(7.0)
        lat = F.lit(55.60) + F.lit(0.012) * ((F.col("a0") % 4) + ((F.col("a1") % 4) - (F.col("a0") % 4)) * part) \
            + F.lit(0.000001) * ((e * 7919) % 401 - 200)
        lon = F.lit(12.50) + F.lit(0.018) * ((F.col("a0") % 3) + ((F.col("a1") % 3) - (F.col("a0") % 3)) * part) \
            + F.lit(0.000001) * ((e * 104729) % 401 - 200)
        uid = F.col("user_id").cast("string")
        mode = F.when(m == 0, "walk").when(m == 1, "bike").when(m == 2, "bus").otherwise("car")
        return a.select(uid.alias("user_id"), F.concat(uid, F.lit(":"), F.col("trip").cast("string")).alias("traj_id"),
                        t.cast("double").alias("t"), lat.alias("lat"), lon.alias("lon"), mode.alias("mode"),
                        e.alias("event_id"), F.col("trip"), F.col("i"))

    def fixes(self) -> DataFrame:
        """Canonical point table plus event_id, trip and i (for deriving dirty variants)."""
        return self.store.view("fixes", self._fixes)

    def points(self) -> DataFrame:
        return self.fixes().select("user_id", "traj_id", "t", "lat", "lon", "mode")

    def dirty(self) -> DataFrame:
        """Fixes with missing, (0,0), duplicate-time and far-off rows."""
        e = F.col("event_id")
        p = self.fixes()
        base = p.select("user_id", "traj_id", "t",
                        F.when(e % 97 == 0, F.lit(None)).when(e % 89 == 0, 0.0).otherwise(F.col("lat")).alias("lat"),
                        F.when(e % 97 == 0, F.col("lon")).when(e % 89 == 0, 0.0).otherwise(F.col("lon")).alias("lon"),
                        "mode", e.alias("row_no"))
        dup = p.filter(e % 83 == 0).select("user_id", "traj_id", "t", (F.col("lat") + 0.001).alias("lat"), "lon",
                                           "mode", (e + 100_000_000).alias("row_no"))
        jump = p.filter(e % 79 == 0).select("user_id", "traj_id", (F.col("t") + 0.5).alias("t"),
                                            (F.col("lat") + 0.5).alias("lat"), "lon", "mode",
                                            (e + 200_000_000).alias("row_no"))
        return base.unionByName(dup).unionByName(jump)

    # ------------------------------------------------------------------ shared views
    def trips(self) -> DataFrame:
        """One row per trip with its split."""
        return self.store.view("trips", lambda: splits.split_by_time(self.points()))

    def grid(self) -> grids.SquareGrid:
        return grids.SquareGrid.fit(self.points(), CELL_M)

    def windows(self) -> DataFrame:
        """Long windows: one row per (window_id, pos)."""
        def build():
            w = views.make_windows(self.points(), LENGTH, LENGTH, MAX_GAP_S)
            return w.join(self.trips().select("traj_id", "split"), "traj_id")
        return self.store.view("windows", build)

    def stays(self) -> DataFrame:
        def build():
            s = views.staypoints_from_trips(self.points(), MIN_STAY_S, MAX_LINK_M, MAX_STAY_S)
            g = self.grid()
            s = s.withColumn("cell", g.cell(F.col("lat"), F.col("lon")))
            return s.join(self.trips().select("traj_id", "split"), "traj_id")
        return self.store.view("stays", build)

    def visits(self) -> DataFrame:
        return self.store.view("visits", lambda: views.visit_sequences(self.stays(), CONTEXT, 1))


# ---------------------------------------------------------------------------- the same in SQL
def hav(lat1, lon1, lat2, lon2) -> str:
    a = (f"(pow(sin((radians({lat2})-radians({lat1}))/2),2)"
         f" + cos(radians({lat1}))*cos(radians({lat2}))*pow(sin((radians({lon2})-radians({lon1}))/2),2))")
    # least() skips missing values there, the added term keeps them missing
    return f"(2 * 6371008.8::DOUBLE * asin(sqrt(least({a}, 1.0::DOUBLE) + 0 * {a})))"


def sql_hex(seed, salt, *keys) -> str:
    return f"md5(concat_ws('|', '{seed}', '{salt}', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in keys) + "))"


def sql_draw(seed, salt, *keys) -> str:
    return f"CAST('0x' || substr({sql_hex(seed, salt, *keys)}, 1, 15) AS BIGINT)"


def sql_uniform(seed, salt, *keys) -> str:
    return f"({sql_draw(seed, salt, *keys)}::DOUBLE / 1152921504606846976.0::DOUBLE)"


def sql_normal(seed, salt, *keys) -> str:
    return (f"(sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {sql_uniform(seed, salt + '.u', *keys)}))"
            f" * cos(2.0::DOUBLE * pi() * {sql_uniform(seed, salt + '.v', *keys)}))")


_KX = "(0.017453292519943295::DOUBLE * 6371008.8::DOUBLE)"


def sql_x(lon: str) -> str:
    return f"(({lon} - g.lon0) * g.kx)"


def sql_y(lat: str) -> str:
    return f"(({lat} - g.lat0) * {_KX})"


def sql_cell(lat: str, lon: str) -> str:
    """Cell of a point, with the one-row ``grid`` in scope as ``g``."""
    ix = f"least(greatest(floor(({sql_x(lon)} - g.x0) / 500.0::DOUBLE), 0), g.nx - 1)"
    iy = f"least(greatest(floor(({sql_y(lat)} - g.y0) / 500.0::DOUBLE), 0), g.ny - 1)"
    return f"CAST({iy} * g.nx + {ix} AS BIGINT)"


CTES: dict[str, tuple[list[str], str]] = {
    "e": ([], "SELECT user_id, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events"),
    "k": (["e"], "SELECT user_id, event_id, CAST(FLOOR(rn / 8.0) AS BIGINT) AS trip, CAST(rn % 8 AS BIGINT) AS i FROM e"),
    "a": (["k"], """SELECT user_id, event_id, trip, i,
         (user_id * 31 + trip * 17) % 11 AS a0, (user_id * 31 + (trip + 1) * 17) % 11 AS a1,
         (user_id + trip) % 4 AS m FROM k"""),
    "fixes": (["a"], """SELECT CAST(user_id AS VARCHAR) AS user_id,
       CONCAT(CAST(user_id AS VARCHAR), ':', CAST(trip AS VARCHAR)) AS traj_id,
       CAST(1704067200 + (user_id % 7) * 3600 + trip * 21600
            + i * (CASE m WHEN 0 THEN 60 WHEN 1 THEN 30 WHEN 2 THEN 20 ELSE 15 END) + event_id % 7 AS DOUBLE) AS t,
       CAST(55.60 AS DOUBLE) + CAST(0.012 AS DOUBLE) * ((a0 % 4) + ((a1 % 4) - (a0 % 4)) * (i / CAST(7.0 AS DOUBLE)))
            + CAST(0.000001 AS DOUBLE) * ((event_id * 7919) % 401 - 200) AS lat,
       CAST(12.50 AS DOUBLE) + CAST(0.018 AS DOUBLE) * ((a0 % 3) + ((a1 % 3) - (a0 % 3)) * (i / CAST(7.0 AS DOUBLE)))
            + CAST(0.000001 AS DOUBLE) * ((event_id * 104729) % 401 - 200) AS lon,
       CASE m WHEN 0 THEN 'walk' WHEN 1 THEN 'bike' WHEN 2 THEN 'bus' ELSE 'car' END AS mode,
       event_id, trip, i FROM a"""),
    "points": (["fixes"], "SELECT user_id, traj_id, t, lat, lon, mode FROM fixes"),
    "dirty": (["fixes"], """SELECT user_id, traj_id, t,
        CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN 0.0 ELSE lat END AS lat,
        CASE WHEN event_id % 97 = 0 THEN lon WHEN event_id % 89 = 0 THEN 0.0 ELSE lon END AS lon, mode, event_id AS row_no FROM fixes
      UNION ALL SELECT user_id, traj_id, t, lat + 0.001::DOUBLE, lon, mode, event_id + 100000000 FROM fixes WHERE event_id % 83 = 0
      UNION ALL SELECT user_id, traj_id, t + 0.5::DOUBLE, lat + 0.5::DOUBLE, lon, mode, event_id + 200000000 FROM fixes WHERE event_id % 79 = 0"""),
    "trips": (["points"], """SELECT traj_id, user_id, t_start, t_end, n_points,
        CASE WHEN r <= round_even(0.8::DOUBLE * n, 0) THEN 'train'
             WHEN r <= round_even(0.8::DOUBLE * n, 0) + round_even(0.1::DOUBLE * n, 0) THEN 'val' ELSE 'test' END AS split
      FROM (SELECT *, row_number() OVER (ORDER BY t_start, traj_id) AS r, count(*) OVER () AS n FROM
        (SELECT traj_id, min(user_id) AS user_id, min(t) AS t_start, max(t) AS t_end, count(*) AS n_points
         FROM points GROUP BY traj_id))"""),
    "grid": (["points"], f"""SELECT lat0, lon0, kx, (lon_lo - lon0) * kx AS x0, (lat_lo - lat0) * {_KX} AS y0,
        floor(((lon_hi - lon0) * kx - (lon_lo - lon0) * kx) / 500.0::DOUBLE) + 1 AS nx,
        floor(((lat_hi - lat0) * {_KX} - (lat_lo - lat0) * {_KX}) / 500.0::DOUBLE) + 1 AS ny FROM
       (SELECT *, {_KX} * cos(radians(lat0)) AS kx FROM
       (SELECT *, (lat_lo + lat_hi) / 2 AS lat0, (lon_lo + lon_hi) / 2 AS lon0 FROM
       (SELECT min(lat) - 1000.0::DOUBLE/111195.0::DOUBLE AS lat_lo, max(lat) + 1000.0::DOUBLE/111195.0::DOUBLE AS lat_hi,
               min(lon) - 1000.0::DOUBLE/(111195.0::DOUBLE*cos(radians(avg(lat)))) AS lon_lo,
               max(lon) + 1000.0::DOUBLE/(111195.0::DOUBLE*cos(radians(avg(lat)))) AS lon_hi FROM points)))"""),
    "steps": (["points"], """SELECT *, lag(t) OVER w AS pt, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon
        FROM points WINDOW w AS (PARTITION BY traj_id ORDER BY t)"""),
    "segs": (["steps"], """SELECT *, row_number() OVER (PARTITION BY traj_id, seg ORDER BY t) - 1 AS p,
         count(*) OVER (PARTITION BY traj_id, seg) AS seg_n FROM
        (SELECT user_id, traj_id, t, lat, lon, mode, CAST(sum(CASE WHEN t - pt > 300 THEN 1 ELSE 0 END)
           OVER (PARTITION BY traj_id ORDER BY t) AS BIGINT) AS seg FROM steps)"""),
    "win": (["segs", "trips"], """SELECT concat(s.traj_id, '#', CAST(seg AS VARCHAR), '#', CAST(p // 8 AS VARCHAR)) AS window_id,
          s.user_id, s.traj_id, CAST(p % 8 AS BIGINT) AS pos, t, lat, lon, mode, tr.split
        FROM segs s JOIN trips tr ON s.traj_id = tr.traj_id WHERE (p // 8 + 1) * 8 <= seg_n"""),
    "ends": (["points"], """SELECT user_id, traj_id, min(t) AS t_start, max(t) AS t_end, arg_min(lat, t) AS lat_s, arg_min(lon, t) AS lon_s,
          arg_max(lat, t) AS lat_e, arg_max(lon, t) AS lon_e FROM points GROUP BY user_id, traj_id"""),
    "stays": (["ends", "grid", "trips"], f"""SELECT s.*, {sql_cell('s.lat', 's.lon')} AS cell, tr.split FROM
        (SELECT user_id, traj_id, CASE WHEN d <= 500 THEN (lat_e + nlat) / 2 ELSE lat_e END AS lat,
           CASE WHEN d <= 500 THEN (lon_e + nlon) / 2 ELSE lon_e END AS lon, t_end AS t_arrive, nstart AS t_leave FROM
          (SELECT *, {hav('lat_e', 'lon_e', 'nlat', 'nlon')} AS d FROM
            (SELECT *, lead(t_start) OVER w AS nstart, lead(lat_s) OVER w AS nlat, lead(lon_s) OVER w AS nlon FROM ends
              WINDOW w AS (PARTITION BY user_id ORDER BY t_start, traj_id)))
          WHERE nstart - t_end >= 1200 AND nstart - t_end <= 259200) s, grid g, trips tr WHERE tr.traj_id = s.traj_id"""),
    "vnum": (["stays"], """SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_arrive, traj_id) - 1 AS idx FROM stays"""),
    # one row per (sample, context position k = 1..3)
    "ctx": (["vnum"], """SELECT concat(v.user_id, '@', CAST(v.idx AS VARCHAR)) AS sample_id, v.user_id, v.split,
          CAST(c.idx - v.idx + 4 AS BIGINT) AS k, c.lat, c.lon, c.cell, c.t_arrive, c.t_leave,
          (c.split = v.split) AS in_split
        FROM vnum v JOIN vnum c ON c.user_id = v.user_id AND c.idx >= v.idx - 3 AND c.idx < v.idx WHERE v.idx >= 3"""),
    "tgt": (["vnum"], """SELECT concat(v.user_id, '@', CAST(v.idx AS VARCHAR)) AS sample_id, v.user_id, v.split, v.lat, v.lon, v.cell, v.t_arrive,
          v.t_leave, v.t_arrive - c.t_leave AS travel_s, v.t_leave - v.t_arrive AS duration_s,
          c.cell AS last_cell FROM vnum v JOIN vnum c ON c.user_id = v.user_id AND c.idx = v.idx - 1 WHERE v.idx >= 3"""),
}


def sql(body: str, *needs: str, extra: dict[str, tuple[list[str], str]] | None = None) -> str:
    """``WITH`` the named views (and what they need) in front of ``body``."""
    known = {**CTES, **(extra or {})}
    order: list[str] = []

    def add(name):
        for dep in known[name][0]:
            add(dep)
        if name not in order:
            order.append(name)
    for name in needs:
        add(name)
    if not order:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({known[n][1]})" for n in order) + "\n" + body
