"""Streaming twins (R): run over the fixes as a file stream and compared with the batch result."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wayspark.session import work_dir
from wayspark.streaming import board, fixes as S

from .common import longs, rounded
from .core import ORACLES as CORE
from .generation import _REC, _records_from
from .inputs import Inputs, sql, sql_cell

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


SLICES, LATE_S = 4, 3000        # fixes arrive up to this late, within the watermark of an hour


def _run(d, name, build):
    """Feeds the fixes in slices of their arrival, shuffled within the allowed lateness, then one far-off closing fix that lets the
    watermark pass everything."""
    base = f"{work_dir(d.spark)}/streams/{name}-{uuid.uuid4().hex[:8]}"
    p = d.points().select("user_id", "traj_id", "t", "lat", "lon")
    stream = lambda: build(S.read_fixes(d.spark, base + "/in/*"))
    arrival = F.col("t") + F.pmod(F.xxhash64("traj_id", "t"), F.lit(LATE_S))
    first, last = p.agg(F.min(arrival), F.max(arrival)).first()
    width = (last - first) / SLICES + 1
    for n in range(SLICES):
        p.filter(F.floor((arrival - first) / width) == n).write.parquet(f"{base}/in/{n}")
        S.run_available(stream(), base + "/out", base + "/state")
    end = p.limit(1).select(F.lit("_end").alias("user_id"), F.lit("_end").alias("traj_id"), F.lit(4102444800.0).alias("t"), "lat", "lon")
    end.write.parquet(base + "/in/end")
    S.run_available(stream(), base + "/out", base + "/state")
    return d.spark.read.parquet(base + "/out")


@query("R1_gap_sessions", sql("SELECT traj_id, count(*) AS n, min(t) AS t_first, max(t) AS t_last FROM (SELECT traj_id, t, sum(CASE WHEN t - pt > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY traj_id ORDER BY t) AS seg FROM steps) GROUP BY traj_id, seg", "steps"))
def r1(d):
    return _run(d, "gaps", lambda f: S.gap_sessions(f, 30)).filter("traj_id <> '_end'")


@query("R2_online_min_interval", CORE["P6_min_interval"])
def r2(d):
    return _run(d, "keep", lambda f: S.keep_filter(f, min_interval_s=40.0)).filter("traj_id <> '_end'").select("traj_id", "t")


@query("R3_online_staypoints", CORE["V2_staypoints_points"])
def r3(d):
    return rounded(_run(d, "stays", lambda f: S.online_staypoints(f)).filter("user_id <> '_end'"), lat=7, lon=7)


@query("R4_window_counts", sql(f"SELECT CAST(floor(t / 3600) * 3600 AS BIGINT) AS start_s, {sql_cell('p.lat', 'p.lon')} AS cell, count(*) AS n FROM points p, grid g GROUP BY ALL", "points", "grid"))
def r4(d):
    g = d.grid()
    return _run(d, "counts", lambda f: S.window_counts(f, g.cell(F.col("lat"), F.col("lon")))).filter("start_s < 4102444800 - 3600")


@query("R5_leaderboard_refresh", sql("""SELECT task, metric, model, round(avg(v), 5) AS value, count(*) AS n_runs FROM (SELECT model, run_tag, task, metric, eval_seed, protocol, arg_max(value, event_id) AS v FROM rec GROUP BY ALL) GROUP BY task, metric, model""", "rec", extra=_REC))
def r5(d):
    base = f"{work_dir(d.spark)}/streams/board-{uuid.uuid4().hex[:8]}"
    events = d.spark.readStream.schema(d.table("events").schema).parquet(f"{d.sf_dir}/events.parquet*")
    board.refresh(_records_from(events, F.col("event_id").alias("order_no")), base + "/journal", base + "/state")
    b = board.current_board(d.spark.read.parquet(base + "/journal"))
    return rounded(b.select("task", "metric", "model", "value", "n_runs"), value=5)
