"""Streaming twins of batch operators over live fixes.

Each takes and returns a streaming DataFrame; on closed input the output equals the batch operator.
Fixes later than the watermark are dropped by the engine and show in the progress metrics
(numRowsDroppedByWatermark).
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.prep import _haversine
from ..operators.views import _StayScan

FIX_SCHEMA = "user_id string, traj_id string, t double, lat double, lon double"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_fixes(spark: SparkSession, path: str, files_per_trigger: int | None = None, watermark: str = "1 hour") -> DataFrame:
    """Stream of Parquet fixes with an event-time column ``ts``."""
    reader = spark.readStream.schema(FIX_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("bigint"))).withWatermark("ts", watermark)


def gap_sessions(fixes: DataFrame, max_gap_s: int) -> DataFrame:
    """One row per gap segment once the watermark has passed it."""
    s = fixes.groupBy("traj_id", F.session_window("ts", f"{max_gap_s} seconds").alias("w"))
    return s.agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t_first"), F.max("t").alias("t_last")).drop("w")


def window_counts(fixes: DataFrame, cell, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Fixes per cell in tumbling or sliding windows."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = fixes.groupBy(w.alias("w"), cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.unix_seconds("w.start").alias("start_s"), "cell", "n")


class _Ordered(StatefulProcessor):
    """Holds fixes back until the watermark has passed them, then hands them on in order of time, so that the order of arrival
    does not matter. A key silent for ``idle_s`` of event time is finished and its state freed; a later fix starts anew.

    A call serves all keys of a bucket (``_by_bucket``), as a call and its reads and writes of state cost far more than a fix.
    Subclasses say which column is the key (``BY``), what they keep (``KEPT``), and give ``begin``, ``step`` and ``finish``.
    """

    BY: str
    KEPT: str
    FIX = "t double, lat double, lon double, user_id string, traj_id string"

    def __init__(self, idle_s: float):
        self.idle_s, self.by = idle_s, {"user_id": 3, "traj_id": 4}[self.BY]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.FIX)
        self.open = handle.getListState("open", f"by string, seen double, {self.KEPT}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for part in rows:
            part = part[["t", "lat", "lon", "user_id", "traj_id"]]
            self.waiting.appendList([(float(t), float(lat), float(lon), user, traj) for t, lat, lon, user, traj in part.itertuples(index=False, name=None)])
            first = float(part["t"].min())
            earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self.handle.registerTimer(_millis(earliest))
        yield self.table([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in rows if _millis(r[0]) <= passed), key=lambda r: (r[0], r[4] is not None, r[4] or "", r[1], r[2]))
        left = [r for r in rows if _millis(r[0]) > passed]
        if due:
            self.waiting.clear()
            if left:
                self.waiting.put(left)
        kept = {r[0]: (r[1], tuple(r[2:])) for r in map(tuple, self.open.get())} if self.open.exists() else {}
        work = {by: (self.begin(state), seen) for by, (seen, state) in kept.items()}
        out = []
        for r in due:
            by = r[self.by]
            mine, last = work.get(by, (None, None))
            if last is not None and r[0] - last > self.idle_s:
                out.extend(self.finish(mine))
                mine = None
            if mine is None:
                mine = self.begin(None)
            out.extend(self.step(mine, r))
            work[by] = mine, r[0]
        over = {by: _millis(last + self.idle_s) + 1 for by, (_, last) in work.items()}
        closed = [by for by, at in over.items() if at <= passed]
        for by in closed:
            out.extend(self.finish(work.pop(by)[0]))
        if due or closed:
            self.open.clear()
            if work:
                self.open.put([(by, last, *self.keep(mine)) for by, (mine, last) in work.items()])
        ahead = [over[by] for by in work] + [_millis(r[0]) for r in left]
        if ahead:
            self.handle.registerTimer(min(ahead))
        yield self.table(out)

    def close(self) -> None:
        pass


BUCKETS = 1024          # part of a checkpoint: a stream goes on with the number it began with


def _by_bucket(fixes: DataFrame, by: str, processor: _Ordered, schema: str) -> DataFrame:
    fixes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return fixes.withColumn("_bucket", F.pmod(F.xxhash64(by), F.lit(BUCKETS)).cast("int")).groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def _millis(t: float) -> int:
    """The millisecond at which the watermark has passed a fix."""
    return math.ceil(t * 1000)


class _KeepFilter(_Ordered):
    """Keeps the last kept fix of the trajectory."""

    BY, KEPT = "traj_id", "t double, lat double, lon double"

    def __init__(self, min_interval_s: float | None, max_speed_mps: float | None, idle_s: float):
        super().__init__(idle_s)
        self.min_interval_s, self.max_speed_mps = min_interval_s, max_speed_mps

    def begin(self, kept):
        return {"last": kept}

    def step(self, work, row):
        if work["last"] is not None and not self._follows(work["last"], row):
            return []
        work["last"] = row[:3]
        return [(row[3], row[4], *row[:3])]

    def keep(self, work):
        return work["last"]

    def finish(self, work):
        return []

    def table(self, out) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["user_id", "traj_id", "t", "lat", "lon"])

    def _follows(self, last, row) -> bool:
        if self.min_interval_s is not None and row[0] - last[0] < self.min_interval_s:
            return False
        return self.max_speed_mps is None or _haversine(last, row[:3]) / max(row[0] - last[0], 1.0) <= self.max_speed_mps


def keep_filter(fixes: DataFrame, min_interval_s: float | None = None, max_speed_mps: float | None = None,
                idle_s: float = 7 * 86400.0) -> DataFrame:
    """Minimum-interval and speed filter against the last kept fix, once the watermark has passed the fix."""
    return _by_bucket(fixes, _KeepFilter.BY, _KeepFilter(min_interval_s, max_speed_mps, idle_s), FIX_SCHEMA)


class _OnlineStays(_Ordered):
    """Keeps the open anchor with the fixes that may still be scanned again, or their running sums once the stay is long enough."""

    BY = "user_id"
    KEPT = ("t array<double>, lat array<double>, lon array<double>, traj array<string>, n bigint, sum_lat double, sum_lon double, "
            "last_t double, last_lat double, last_lon double, last_traj string, user string")

    def __init__(self, dist_m: float, time_s: float, idle_s: float):
        super().__init__(idle_s)
        self.dist_m, self.time_s = dist_m, time_s

    def begin(self, kept):
        scan = _StayScan(self.dist_m, self.time_s)
        if kept is not None:
            scan.open = list(zip(kept[0], kept[1], kept[2], kept[3]))
            scan.n, scan.lat, scan.lon, scan.last = kept[4], kept[5], kept[6], tuple(kept[7:11])
        return {"scan": scan, "user": kept[11] if kept is not None else None}

    def step(self, work, row):
        work["user"] = row[3]
        return [(row[3], *s) for s in work["scan"].step((row[0], row[1], row[2], row[4]))]

    def keep(self, work):
        scan = work["scan"]
        t, lat, lon, traj = (list(c) for c in zip(*scan.open))
        return (t, lat, lon, traj, scan.n, scan.lat, scan.lon, *scan.last, work["user"])

    def finish(self, work):
        return [(work["user"], *s) for s in work["scan"].close()]

    def table(self, out) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["user_id", "traj_id", "lat", "lon", "t_arrive", "t_leave"])


def online_staypoints(fixes: DataFrame, dist_m: float = 200.0, time_s: float = 1200.0, idle_s: float = 7 * 86400.0) -> DataFrame:
    """Staypoints as they end, once the watermark has passed them; a user silent for ``idle_s`` of event time is closed."""
    return _by_bucket(fixes, _OnlineStays.BY, _OnlineStays(dist_m, time_s, idle_s),
                      "user_id string, traj_id string, lat double, lon double, t_arrive double, t_leave double")


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that is there, then stop; exactly once through the file sink's log."""
    query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint) \
        .outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
