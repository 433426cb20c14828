"""Generation realism: five statistics, visited cells and the copy check."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import generation as G
from ..operators import scores, views
from ..operators.grid import SquareGrid
from ..session import cut_lineage

STATS = ("radius_of_gyration", "jump_length", "stay_duration", "daily_locations")


def generated_stays(points: DataFrame, dist_m: float, time_s: float) -> DataFrame:
    """Generated trips of one user may overlap in time, so stays are found per trip."""
    return views.staypoints_from_fixes(points, dist_m, time_s, by_trajectory=True)


def generation_eval(real: DataFrame, real_stays: DataFrame, floor: DataFrame, floor_stays: DataFrame, lower: DataFrame,
                    generated: DataFrame, train: DataFrame, grid: SquareGrid, dist_m: float = 200.0, time_s: float = 1200.0, n_boot: int = 200, seed: int = 0) -> DataFrame:
    """(task, metric, value, baseline_value, floor_value, skill, ci_low, ci_high) of ``generated``: divergences against real
    test data, scaled between the real noise floor and the uniform lower reference; rank correlation of the users' median
    radius of gyration (absent below five common users); copying with intervals over ``n_boot`` resamples of the trips."""
    spark = real.sparkSession
    sides = {"real": (real, real_stays), "floor": (floor, floor_stays)}
    for name, pts in (("lower", lower), ("generated", generated)):
        pts = cut_lineage(pts)
        sides[name] = (pts, cut_lineage(generated_stays(pts, dist_m, time_s)))
    stats = {n: cut_lineage(G.trajectory_stats(p, s, grid)) for n, (p, s) in sides.items()}
    rows = []
    for stat in STATS:
        value = {n: s.filter(F.col("stat") == stat) for n, s in stats.items()}
        if not value["real"].limit(1).count():
            continue
        edges = G.bin_edges(value["real"], stat)
        found = {n: G.compare_stat(value["real"], value[n], edges) for n in ("floor", "lower", "generated")}
        for i, metric in enumerate(("jsd", "w1")):
            rows.append((f"generation/{stat}", metric, *(found[n][i] for n in ("generated", "lower", "floor"))))
    cells = {n: G.visited_cells(s, grid) for n, (_, s) in sides.items()}
    both = {n: G.jsd(cells["real"], cells[n]).first()[0] for n in ("generated", "lower", "floor")}
    rows.append(("generation/visited_cells", "jsd", both["generated"], both["lower"], both["floor"]))
    gyration = {n: stats[n].filter(F.col("stat") == "radius_of_gyration").select("user_id", "value") for n in ("real", "generated")}
    rho = G.paired_spearman(gyration["real"], gyration["generated"]).first()["rho"]
    if rho is not None:
        rows.append(("generation/radius_of_gyration", "spearman_paired:radius_of_gyration", rho, None, None))
    kinds = "task string, metric string, value double, baseline_value double, floor_value double"
    table = spark.createDataFrame(rows, kinds)               # a few rows of results
    skill = scores.skill_score(F.col("value"), F.col("baseline_value"), F.lit("floor"), F.col("floor_value"))
    out = table.withColumn("skill", skill)
    threshold = G.exact_percentiles(G.nearest_train_distance(real, train), [], "dist_m", {"p": 0.05}).first()[0]
    copies = cut_lineage(G.copy_metrics(G.nearest_train_distance(sides["generated"][0], train), threshold).select(
        F.lit("generation/memorisation").alias("task"), F.col("traj_id").alias("sample_id"), "metric", "value"))
    memo = scores.aggregate_values(copies, ["task"], written=True).select("task", "metric", "value")
    memo = memo.join(scores.bootstrap_ci(copies, ["task"], n_boot, seed), ["task", "metric"], "left")
    return out.unionByName(memo, allowMissingColumns=True)
