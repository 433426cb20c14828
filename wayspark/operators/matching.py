"""Map matching with a hidden Markov model: candidates, routes and transitions are joins, only the
best-path recursion runs per trip."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import to_xy
from ..functions.ordered import neighbour, running
from ..functions.scan import group_scan
from ..functions.tiles import tile_routes
from ..session import cut_lineage
from .prep import per_trajectory
from .proximity import place_roads, road_pieces


class _BestPath:
    """Max-sum recursion over one chain; ties go to the earlier state."""

    def __init__(self, beta_m: float):
        self.beta_m, self.steps, self.score, self.last = beta_m, [], None, None

    def step(self, row):
        t, gc, seg, forward, along, length, emit, entry, leave, entries, routes = row
        now = (np.array(seg), np.array(forward), np.array(along, float), np.array(length, float), np.array(leave))
        emit, back = np.array(emit, float), None
        if self.score is not None:
            total = self.score[:, None] + self._transitions(now, np.array(entry), gc, entries, routes)
            best = total.max(0)
            if np.isfinite(best).any():
                back, self.score = total.argmax(0), best + emit
            else:                                        # nothing reachable: a new chain starts here
                back, self.score = int(self.score.argmax()), emit
        else:
            self.score = emit
        self.last = now
        self.steps.append((t, seg, back))
        return ()

    def _transitions(self, now, entry, gc, entries, routes):
        """``routes``: the number of an exit and the distances from there to all entries; states name both by number."""
        seg, forward, along, length, leave = self.last
        gap = np.full((int(leave.max()) + 1, entries), np.inf)
        for r in routes or ():
            if r["i"] < len(gap):
                gap[r["i"]] = [np.inf if d is None else d for d in r["gap"]]
        route = (length - along)[:, None] + gap[np.ix_(leave, entry)] + now[2][None, :]
        ahead = now[2][None, :] - along[:, None]
        same = (seg[:, None] == now[0][None, :]) & (forward[:, None] == now[1][None, :]) & (ahead >= -1.0)
        return -np.abs(np.where(same, ahead, route) - gc) / self.beta_m

    def close(self):
        out, j = [], int(self.score.argmax())
        for t, segs, back in reversed(self.steps):
            out.append((t, segs[j]))
            if back is not None:
                j = back if isinstance(back, int) else int(back[j])
        return reversed(out)


def place_states(points: DataFrame, segments: DataFrame, lat0: float, lon0: float, radius_m: float = 60.0, k: int = 8) -> DataFrame:
    """Candidate states of every distinct position: (lat, lon, x, y, s), s in the order of distance, segment and direction. Two-way
    segments give one state per direction; ``along`` is the position in travel direction."""
    pieces = cut_lineage(road_pieces(segments, lat0, lon0))
    sizes = pieces.groupBy("seg_id").agg(F.sum("len").alias("seg_len"))
    roads = segments.select("seg_id", "u", "v", "oneway").join(sizes, "seg_id")
    near = place_roads(points, pieces, radius_m, k, lat0, lon0).join(roads, "seg_id")
    ways = F.when(F.col("oneway"), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))
    s = near.withColumn("forward", F.explode(ways))
    ahead = lambda a, b: F.when(F.col("forward"), F.col(a)).otherwise(F.col(b))
    one = F.struct("dist", F.col("seg_id").alias("seg"), (~F.col("forward")).alias("back"), "forward", F.when(F.col("forward"), F.col("off")).otherwise(F.col("seg_len") - F.col("off")).alias("along"),
                   "seg_len", ahead("u", "v").alias("entry"), ahead("v", "u").alias("exit"))
    return s.groupBy("lat", "lon", "x", "y").agg(F.sort_array(F.collect_list(one)).alias("s"))           # 2 k states at most


def match_states(points: DataFrame, segments: DataFrame, lat0: float, lon0: float, radius_m: float = 60.0, k: int = 8) -> DataFrame:
    """Candidate states of every fix: (traj_id, t, x, y, seg, forward, along, dist, state)."""
    places = place_states(points, segments, lat0, lon0, radius_m, k)
    rows = points.select("traj_id", "t", "lat", "lon").join(places, ["lat", "lon"]).select("traj_id", "t", "x", "y", F.posexplode("s").alias("state", "c"))
    return rows.select("traj_id", "t", "x", "y", *[F.col(f"c.{n}").alias(n) for n in ("seg", "forward", "along", "dist", "seg_len", "entry", "exit")], "state")


@per_trajectory
def _after(fixes: DataFrame, chunk: Column | None) -> DataFrame:
    return neighbour(fixes, ["traj_id"], ["t"], ["x", "y", "exits", "ways"], "p_", chunk)


@per_trajectory
def _chains(steps: DataFrame, chunk: Column | None) -> DataFrame:
    return running(steps, ["traj_id"], ["t"], {"chain": F.when(F.col("linked"), 0).otherwise(1).cast("bigint")}, chunk)


def _road_edges(segments: DataFrame, lat0: float, lon0: float) -> DataFrame:
    """Travel edges (a, b, w) in planar metres with the places of their ends and the boxes of their pieces; parallel segments stay apart."""
    pieces = road_pieces(segments, lat0, lon0)
    one = F.struct(F.least("x0", "x1").alias("x0"), F.least("y0", "y1").alias("y0"), F.greatest("x0", "x1").alias("x1"), F.greatest("y0", "y1").alias("y1"))
    whole = pieces.groupBy("seg_id").agg((F.sum("len") + 1e-6).alias("w"), F.collect_list(one).alias("pieces"), F.min_by(F.struct("x0", "y0"), "k").alias("s"),
                                         F.max_by(F.struct(F.col("x1").alias("x0"), F.col("y1").alias("y0")), "k").alias("e"))
    rows = segments.select("seg_id", "u", "v", "oneway").join(whole, "seg_id")
    way = lambda r, a, b, s, e: r.select(F.col(a).alias("a"), F.col(b).alias("b"), "w", "pieces", *[F.col(f"{p}.{c}0").alias(f"{n}_{c}") for p, n in ((s, "a"), (e, "b")) for c in "xy"])
    return way(rows, "u", "v", "s", "e").unionByName(way(rows.filter("not oneway"), "v", "u", "e", "s"))


def match_steps(points: DataFrame, places: DataFrame, segments: DataFrame, lat0: float, lon0: float, sigma_m: float = 20.0, radius_m: float = 60.0,
                margin_m: float = 1500.0) -> DataFrame:
    """One row per fix with its states, the distance from the previous fix and the routes that can
    link the two: (traj_id, chain, t, gc, seg[], ..., routes).

    Routes are looked up per *distinct pair of nodes* of a step, not per pair of states. A trip's routes reach 3 x its longest step + 2 x radius + margin, on
    segments that touch the trip's box, wider by the margin. Steps that ask the same (node, reach, box) are searched once,
    tile by tile, until the nodes asked for are found. Where nothing can link two fixes the trip is cut for certain (``chain``).
    """
    seen = F.transform("s", lambda v: v.withField("e", -0.5 * (v["dist"] / sigma_m) ** 2))
    ways = F.transform("s", lambda v: F.concat_ws("/", v["seg"].cast("string"), v["forward"].cast("string")))
    places = places.select("lat", "lon", "x", "y", seen.alias("s"), F.array_distinct("s.exit").alias("exits"), F.array_distinct("s.entry").alias("entries"), ways.alias("ways"))
    s = cut_lineage(points.select("traj_id", "t", "lat", "lon").join(places, ["lat", "lon"]).drop("lat", "lon"))      # measured, then read
    near = _after(s).withColumn("gc", F.sqrt((F.col("x") - F.col("p_x")) ** 2 + (F.col("y") - F.col("p_y")) ** 2))
    near = cut_lineage(near.drop("x", "y", "p_x", "p_y"))
    x, y = to_xy(F.col("lat"), F.col("lon"), lat0, lon0)
    boxes = points.select("traj_id", x.alias("x"), y.alias("y")).groupBy("traj_id").agg(
        *[(f(c) + d).alias(c + n) for f, d, n in ((F.min, -margin_m, "0"), (F.max, margin_m, "1")) for c in "xy"])
    limits = near.groupBy("traj_id").agg((3.0 * F.coalesce(F.max("gc"), F.lit(0.0)) + 2 * radius_m + margin_m).alias("limit_m"))
    job = ["source", "limit_m", "x0", "y0", "x1", "y1"]
    asked = near.filter("gc is not null").select("traj_id", "t", "entries", "p_exits", F.explode("p_exits").alias("source")).join(limits.join(boxes, "traj_id"), "traj_id")
    edges = cut_lineage(_road_edges(segments, lat0, lon0))
    places = edges.select(F.explode(F.array(*[F.struct(F.col(n).alias("source"), F.col(f"{n}_x").alias("s_x"), F.col(f"{n}_y").alias("s_y")) for n in "ab"])).alias("p")) \
        .select("p.*").groupBy("source").agg(F.first("s_x").alias("s_x"), F.first("s_y").alias("s_y"))
    searches = asked.select(*job, F.explode("entries").alias("target")).groupBy(*job).agg(F.collect_set("target").alias("targets")).join(places, "source")
    routes = tile_routes(edges, cut_lineage(searches), ["x", "y"], box=True)
    # a step and source has one row: the distances of its entries in their order, null where there is no route
    known = F.map_from_arrays("nodes", "ds")
    gaps = asked.join(routes, job).withColumn("known", known).select("traj_id", "t", (F.array_position("p_exits", F.col("source")) - 1).cast("int").alias("i"),
                                                                     F.transform("entries", lambda e: F.try_element_at("known", e)).alias("gap"))
    found = gaps.filter(F.exists("gap", lambda g: g.isNotNull())).groupBy("traj_id", "t").agg(F.collect_list(F.struct("i", "gap")).alias("r"))
    linked = F.col("r").isNotNull() | F.coalesce(F.arrays_overlap("p_ways", "ways"), F.lit(False))
    steps = near.join(found, ["traj_id", "t"], "left").withColumn("linked", linked)
    part = lambda n: F.col(f"s.{n}").alias(n)
    number = lambda nodes, where: F.transform(nodes, lambda e: (F.array_position(F.col(where), e) - 1).cast("int"))
    rows = steps.select("traj_id", "t", "gc", "linked", *[part(n) for n in ("seg", "forward", "along", "seg_len", "e")], number(F.col("s.entry"), "entries").alias("entry"),
                        number(F.col("s.exit"), "exits").alias("exit"), F.size("entries").alias("n_entries"),
                        F.col("r").alias("routes"))
    return _chains(cut_lineage(rows)).drop("linked")


def match(points: DataFrame, segments: DataFrame, lat0: float, lon0: float, sigma_m: float = 20.0, beta_m: float = 50.0, radius_m: float = 60.0,
          k: int = 8, margin_m: float = 1500.0) -> DataFrame:
    """(traj_id, t, seg) for every fix; -1 without a road in reach."""
    places = place_states(points, segments, lat0, lon0, radius_m, k)
    rows = match_steps(points, places, segments, lat0, lon0, sigma_m, radius_m, margin_m)
    schema = T.StructType([T.StructField("traj_id", T.StringType()), T.StructField("chain", T.LongType()), T.StructField("t", T.DoubleType()), T.StructField("seg", T.LongType())])
    columns = ["t", "gc", "seg", "forward", "along", "seg_len", "e", "entry", "exit", "n_entries", "routes"]
    found = group_scan(rows, ["traj_id", "chain"], ["t"], columns, lambda: _BestPath(beta_m), schema)
    return points.select("traj_id", "t").join(found.drop("chain"), ["traj_id", "t"], "left").withColumn("seg", F.coalesce("seg", F.lit(-1)).cast("bigint"))


def match_rate(matches: DataFrame) -> DataFrame:
    return matches.agg(F.avg(F.when(F.col("seg") >= 0, 1.0).otherwise(0.0)).alias("match_rate"), F.count(F.lit(1)).alias("n"))
