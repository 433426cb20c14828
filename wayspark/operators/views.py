"""Shared views: windows, staypoints, visit sequences and whole trips."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import haversine_m
from ..functions.ordered import by_day, group_size, neighbour, numbered, over_groups, row_blocks, running
from ..functions.scan import group_scan
from .prep import _haversine, as_of, gap_segments, per_trajectory


# ------------------------------------------------------------------ windows
@per_trajectory
def segment_positions(points: DataFrame, max_gap_s: float, chunk: Column | None) -> DataFrame:
    """Adds ``seg``, the 0-based position ``p`` in the gap segment and its size ``seg_n``: one exchange
    on the trajectory for all three."""
    cut = gap_segments(points, max_gap_s, chunk=chunk)
    placed = numbered(cut, ["traj_id", "seg"], ["t"], "p", chunk).withColumn("p", F.col("p") - 1)
    return group_size(placed, ["traj_id", "seg"], "seg_n", chunk)


def make_windows(points: DataFrame, length: int = 64, stride: int | None = None, max_gap_s: float = 300.0,
                 min_purity: float = 0.8) -> DataFrame:
    """Fixed-length windows in long form: (window_id, user_id, traj_id, pos, t, lat, lon[, mode]).

    Starts are 0, stride, ... inside each gap segment; no partial windows. A fix belongs to the
    windows whose start lies within ``length`` before it, so it is copied length / stride times and
    never joined with its neighbours. ``mode`` is the window label where it is pure enough.
    """
    stride = stride or length
    p = segment_positions(points, max_gap_s)
    last = F.floor(F.col("p") / stride)
    first = F.greatest(F.ceil((F.col("p") - (length - 1)) / stride), F.lit(0))
    spread = p.withColumn("_w", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(
        F.array().cast("array<bigint>"))))
    spread = spread.filter(F.col("_w") * stride + length <= F.col("seg_n"))
    if "mode" in points.columns:
        spread = with_window_label(spread, ["traj_id", "seg", "_w"], length, min_purity)
    wid = F.concat_ws("#", "traj_id", F.col("seg").cast("string"), F.col("_w").cast("string"))
    return spread.select(wid.alias("window_id"), "user_id", "traj_id",
                         (F.col("p") - F.col("_w") * stride).cast("bigint").alias("pos"), "t", "lat", "lon",
                         *(["mode"] if "mode" in points.columns else []))


def with_window_label(rows: DataFrame, keys: list[str], length: int, min_purity: float = 0.8) -> DataFrame:
    """``rows`` with ``mode`` replaced by the most common mode of their window, if it holds ``min_purity`` of the labelled fixes and enough of
    the window is labelled at all (ties by name). Fixes of a mode are counted in the window's own partition; no list of modes is built."""
    window = Window.partitionBy(*keys)
    votes = rows.withColumn("_n", F.count("mode").over(Window.partitionBy(*keys, "mode")))
    first = F.min(F.when(F.col("mode").isNotNull(), F.struct((-F.col("_n")).alias("n"), "mode"))).over(window)
    votes = votes.withColumns({"_first": first, "_labelled": F.count("mode").over(window)})
    clear = (-F.col("_first.n") >= min_purity * F.col("_labelled")) & (F.col("_labelled") >= min_purity * length)
    return votes.withColumn("mode", F.when(clear, F.col("_first.mode"))).drop("_n", "_first", "_labelled")


def window_arrays(windows: DataFrame) -> DataFrame:
    """One row per window with its ordered fixes (at most ``length`` of them)."""
    pts = F.sort_array(F.collect_list(F.struct("pos", "t", "lat", "lon"))).alias("pts")
    return windows.groupBy("window_id").agg(F.min("user_id").alias("user_id"), F.min("traj_id").alias("traj_id"), pts)


def odd_even_views(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Query half (odd positions) and database half (even positions) of every window."""
    return windows.filter("pos % 2 = 1"), windows.filter("pos % 2 = 0")


def trajectories(points: DataFrame, max_gap_s: float, min_points: int = 36, max_points: int | None = None) -> DataFrame:
    """Gap-free trips of at least ``min_points`` fixes (and at most ``max_points``, where that is asked for) as ordered
    arrays. An array holds one trip; ``resample_index`` works on trips of any length without one."""
    p = segment_positions(points, max_gap_s).filter(F.col("seg_n") >= min_points)
    if max_points is not None:
        p = p.filter(F.col("seg_n") <= max_points)
    pts = F.sort_array(F.collect_list(F.struct("t", "lat", "lon"))).alias("pts")
    return p.groupBy("user_id", "traj_id", "seg").agg(pts)


# ------------------------------------------------------------------ staypoints
class _StayScan:
    """Open anchor of one run: fixes since the anchor are kept only while the stay is still shorter
    than the threshold; after that running sums suffice."""

    def __init__(self, dist_m: float, time_s: float):
        self.dist_m, self.time_s, self.open = dist_m, time_s, []
        self.n, self.lat, self.lon, self.last = 0, 0.0, 0.0, None

    def step(self, row):
        out = []
        todo = [row]
        while todo:
            r = todo.pop(0)
            if not self.open:
                self._start(r)
            elif _haversine(self.open[0], r) <= self.dist_m:
                self._add(r)
            else:
                done, rest = self._finish()
                out.extend(done)
                todo = rest + [r] + todo
        return out

    def close(self):
        out = []
        while self.open:
            done, rest = self._finish()
            out.extend(done)
            for r in rest:
                out.extend(self.step(r))
        return out

    def _start(self, r):
        self.open, self.n, self.lat, self.lon, self.last = [r], 1, r[1], r[2], r

    def _add(self, r):
        self.n, self.lat, self.lon, self.last = self.n + 1, self.lat + r[1], self.lon + r[2], r
        if r[0] - self.open[0][0] < self.time_s:
            self.open.append(r)
        else:
            del self.open[1:]

    def _finish(self):
        """Emit the stay, or give back the fixes behind the anchor to be scanned again."""
        anchor, rest = self.open[0], self.open[1:]
        self.open = []
        if self.last[0] - anchor[0] >= self.time_s:
            return [(anchor[3], self.lat / self.n, self.lon / self.n, anchor[0], self.last[0])], []
        return [], rest


@over_groups("user_id", chunk=by_day)
def staypoints_from_fixes(points: DataFrame, dist_m: float = 200.0, time_s: float = 1200.0,
                          by_trajectory: bool = False, *, chunk: Column | None) -> DataFrame:
    """Anchor scan per user in time order, across trips (or per trip with ``by_trajectory``).

    A run within ``dist_m`` of its anchor cannot cross a step longer than twice that, so sequences
    are cut at such steps, and pieces shorter than ``time_s`` hold no stay and are dropped unscanned.
    """
    keys = ["user_id", "traj_id"] if by_trajectory else ["user_id"]
    order = ["t", "traj_id"]
    near = neighbour(points, keys, order, ["lat", "lon"], "_p_", chunk)
    jump = haversine_m(F.col("_p_lat"), F.col("_p_lon"), F.col("lat"), F.col("lon")) > 2 * dist_m
    cut = F.when(jump, 1).otherwise(0).cast("bigint")
    runs = running(near, keys, order, {"_run": cut}, chunk)
    piece = [*keys, "_run"]
    if chunk is None:
        w = Window.partitionBy(*piece)
        work = runs.withColumn("_span", F.max("t").over(w) - F.min("t").over(w)).filter(F.col("_span") >= time_s)
    else:
        spans = runs.groupBy(*piece).agg((F.max("t") - F.min("t")).alias("_span")).filter(F.col("_span") >= time_s)
        work = runs.join(spans.select(*piece), piece, "left_semi")
    work = work.withColumn("_trip", F.col("traj_id"))
    schema = T.StructType([*[T.StructField(k, T.StringType()) for k in keys], T.StructField("_run", T.LongType()),
                           T.StructField("stay_traj", T.StringType()),
                           *[T.StructField(n, T.DoubleType()) for n in ("lat", "lon", "t_arrive", "t_leave")]])
    found = group_scan(work, piece, ["t", "_trip"], ["t", "lat", "lon", "_trip"], lambda: _StayScan(dist_m, time_s), schema)
    return found.select("user_id", F.col("stay_traj").alias("traj_id"), "lat", "lon", "t_arrive", "t_leave")


def trip_ends(points: DataFrame) -> DataFrame:
    """First and last fix of every trip, in one combined aggregate."""
    fix = F.struct("t", "lat", "lon")
    ends = points.groupBy("user_id", "traj_id").agg(F.min_by(fix, "t").alias("s"), F.max_by(fix, "t").alias("e"))
    return ends.select("user_id", "traj_id", F.col("s.t").alias("t_start"), F.col("e.t").alias("t_end"),
                       F.col("s.lat").alias("lat_s"), F.col("s.lon").alias("lon_s"),
                       F.col("e.lat").alias("lat_e"), F.col("e.lon").alias("lon_e"))


@over_groups("user_id", chunk=lambda: by_day("t_start", 7 * 86400))
def _next_trip(ends: DataFrame, chunk: Column | None) -> DataFrame:
    return neighbour(ends, ["user_id"], ["t_start", "traj_id"], ["t_start", "lat_s", "lon_s"], "n_", chunk, ahead=True)


def staypoints_from_trips(points: DataFrame, min_stay_s: float = 1200.0, max_link_m: float = 500.0,
                          max_stay_s: float = 259200.0) -> DataFrame:
    """Stays as gaps between a user's consecutive trips."""
    near = _next_trip(trip_ends(points))
    gap = F.col("n_t_start") - F.col("t_end")
    linked = haversine_m(F.col("lat_e"), F.col("lon_e"), F.col("n_lat_s"), F.col("n_lon_s")) <= max_link_m
    middle = lambda a, b: F.when(linked, (F.col(a) + F.col(b)) / 2).otherwise(F.col(a))
    return near.filter((gap >= min_stay_s) & (gap <= max_stay_s)).select(
        "user_id", "traj_id", middle("lat_e", "n_lat_s").alias("lat"), middle("lon_e", "n_lon_s").alias("lon"),
        F.col("t_end").alias("t_arrive"), F.col("n_t_start").alias("t_leave"))


# ------------------------------------------------------------------ visit sequences
VISIT = ("lat", "lon", "cell", "t_arrive", "t_leave", "split")


per_user_month = over_groups("user_id", chunk=lambda: by_day("t_arrive", 28 * 86400))


@per_user_month
def _indexed(stays: DataFrame, chunk: Column | None) -> DataFrame:
    return numbered(stays, ["user_id"], ["t_arrive", "traj_id"], "idx", chunk).withColumn("idx", F.col("idx") - 1)


@per_user_month
def visit_sequences(stays: DataFrame, context: int = 8, stride: int = 1, block: int = 4096, *, chunk: Column | None) -> DataFrame:
    """C context visits -> one target visit, as (sample_id, user_id, split, ctx ARRAY, tgt STRUCT).

    ``split`` is the target's; each context visit says whether it lies in the same one. For hot users
    the rows frame runs in blocks of consecutive visits with a halo.
    """
    visit = F.struct(*VISIT)
    rows = _indexed(stays, chunk=chunk)
    keys = ["user_id"]
    if chunk is None:
        rows = rows.withColumn("_own", F.lit(True))
    else:
        rows, keys = row_blocks(rows, ["user_id"], "idx", block, context), ["user_id", "_block"]
    w = Window.partitionBy(*keys).orderBy("idx").rowsBetween(-context, -1)
    seq = rows.withColumn("ctx", F.collect_list(visit).over(w))
    seq = seq.filter(F.col("_own") & (F.col("idx") >= context) & ((F.col("idx") - context) % stride == 0))
    ctx = F.transform("ctx", lambda v: F.struct(v["lat"].alias("lat"), v["lon"].alias("lon"), v["cell"].alias("cell"),
                                                v["t_arrive"].alias("t_arrive"), v["t_leave"].alias("t_leave"),
                                                (v["split"] == F.col("split")).alias("in_split")))
    travel = F.col("t_arrive") - F.element_at("ctx", -1)["t_leave"]
    tgt = F.struct("lat", "lon", "cell", "t_arrive", "t_leave", travel.alias("travel_s"),
                   (F.col("t_leave") - F.col("t_arrive")).alias("duration_s"))
    return seq.select(F.concat_ws("@", "user_id", F.col("idx").cast("string")).alias("sample_id"), "user_id", "split",
                      ctx.alias("ctx"), tgt.alias("tgt"))


def visits_as_windows(visits: DataFrame) -> DataFrame:
    """The context seen as a short trajectory of arrivals, in long form."""
    return visits.select("sample_id", "user_id", "split", F.posexplode("ctx").alias("pos", "v")).select(
        F.concat_ws(":", F.lit("vctx"), "split", "sample_id").alias("window_id"), "user_id", F.col("pos").cast("bigint"),
        F.col("v.t_arrive").alias("t"), F.col("v.lat").alias("lat"), F.col("v.lon").alias("lon"))


def hide_visit_targets(visits: DataFrame, reveal: tuple[str, ...] = ()) -> DataFrame:
    """Leak guard: the target struct keeps only what is revealed ('location', 'arrival')."""
    show = {"lat": "location" in reveal, "lon": "location" in reveal, "cell": "location" in reveal,
            "t_arrive": "arrival" in reveal, "t_leave": False, "travel_s": False, "duration_s": False}
    fields = [(F.col(f"tgt.{n}") if ok else F.when(F.lit(False), F.col(f"tgt.{n}"))).alias(n) for n, ok in show.items()]
    return visits.withColumn("tgt", F.struct(*fields))


def hide_masked(windows: DataFrame, hidden: str = "hidden") -> DataFrame:
    """Leak guard: coordinates at hidden positions become null; timestamps stay."""
    blank = lambda c: F.when(~F.col(hidden), F.col(c))
    return windows.withColumns({"lat": blank("lat"), "lon": blank("lon")})


@over_groups("user_id", chunk=lambda: by_day("t_leave", 28 * 86400))
def _by_end(stays: DataFrame, chunk: Column | None) -> DataFrame:
    return numbered(stays, ["user_id"], ["t_leave", "traj_id"], "idx", chunk)


def pair_windows_with_visits(windows: DataFrame, stays: DataFrame, context: int) -> DataFrame:
    """Per window the user's last ``context`` stays that ended before it starts, oldest first and
    padded on the right. As-of join on the index of the latest such stay, then an equi-join on
    (user, index): each window meets ``context`` stays at most."""
    starts = windows.groupBy("window_id").agg(F.min("user_id").alias("user_id"), F.min("t").alias("start"))
    ended = _by_end(stays)
    left = starts.select("user_id", F.col("start").alias("_at"), F.lit(1).alias("_side"), "window_id",
                         F.lit(None).cast("bigint").alias("idx"))
    right = ended.select("user_id", F.col("t_leave").alias("_at"), F.lit(0).alias("_side"),
                         F.lit(None).cast("string").alias("window_id"), "idx")
    known = as_of(left.unionByName(right), ["_at", "_side", "window_id"], "idx", "_last").filter("_side = 1").select("window_id", "user_id", "_last")
    wanted = known.withColumn("idx", F.explode(F.when(F.col("_last").isNotNull(), F.sequence(
        F.greatest(F.col("_last") - (context - 1), F.lit(1)), F.col("_last")))))
    rows = wanted.join(ended.select("user_id", "idx", "lat", "lon", "t_arrive", "t_leave"), ["user_id", "idx"])
    lists = rows.groupBy("window_id").agg(F.sort_array(F.collect_list(
        F.struct("idx", "lat", "lon", "t_arrive", "t_leave"))).alias("v"))
    pad = F.concat("v", F.array_repeat(F.lit(None), F.lit(context) - F.size("v")))
    return known.select("window_id", "user_id").join(lists, "window_id", "left").select(
        "window_id", "user_id", F.coalesce(F.size("v"), F.lit(0)).alias("n_visits"),
        F.coalesce(pad, F.array_repeat(F.lit(None), context)).alias("visits"))


@per_user_month
def long_instances(stays: DataFrame, split: str, seq_len: int, stride: int, chunk: Column | None) -> DataFrame:
    """Per user runs of ``seq_len`` visits at starts 0, stride, ...: (user_id, start, end, pad), kept
    when a target of ``split`` lies inside. Counting by running totals, no visit list is built."""
    v = _indexed(stays, chunk=chunk)
    own = F.when(F.col("split") == split, 1).otherwise(0).cast("bigint")
    v = running(v, ["user_id"], ["t_arrive", "traj_id"], {"upto": own}, chunk)
    sizes = v.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("upto").alias("owned")) \
        .filter("n >= 2 and owned > 0")
    top = F.greatest(F.col("n") - seq_len - 1, F.lit(0))
    starts = sizes.withColumn("start", F.explode(F.sequence(F.lit(0), top, F.lit(stride))))
    end = F.least(F.col("start") + seq_len - 1, F.col("n") - 1)
    pad = F.lit(seq_len) - (end - F.col("start") + 1)
    inst = starts.withColumns({"end": end, "pad": pad})
    inst = inst.withColumn("first", F.when(F.col("pad") > 0, F.col("start")).otherwise(F.col("start") + 1))
    at_end = v.select("user_id", F.col("idx").alias("end"), F.col("upto").alias("_hi"))
    before = v.select("user_id", (F.col("idx") + 1).alias("first"), F.col("upto").alias("_lo"))
    out = inst.join(at_end, ["user_id", "end"]).join(before, ["user_id", "first"], "left")
    return out.filter(F.col("_hi") - F.coalesce("_lo", F.lit(0)) > 0).select(
        "user_id", F.col("start").cast("bigint"), F.col("end").cast("bigint"), F.col("pad").cast("bigint"))
