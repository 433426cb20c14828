"""What a data set holds, per split, and how much of the test part training has seen."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import exact_percentiles
from ..operators.grid import SquareGrid, nearest
from ..operators.splits import NAMES, seeded_subset


def summary(points: DataFrame, trips: DataFrame, windows: DataFrame, stays: DataFrame, visits: DataFrame) -> DataFrame:
    """Users, trips, points, windows, stays and visit samples per split, with the share of stays in
    cells that training visited. Trip sizes are pre-aggregated, so points are read once."""
    per_trip = trips.groupBy("split").agg(F.count_distinct("user_id").alias("n_users"), F.count(F.lit(1)).alias("n_trips"))
    sizes = points.groupBy("traj_id").agg(F.count(F.lit(1)).alias("n"))
    n_points = sizes.join(trips.select("traj_id", "split"), "traj_id").groupBy("split").agg(F.sum("n").alias("n_points"))
    n_windows = windows.filter("pos = 0").groupBy("split").agg(F.count(F.lit(1)).alias("n_windows"))
    known = stays.filter("split = 'train'").select("cell").distinct().withColumn("_known", F.lit(1.0))
    per_cell = stays.groupBy("split", "cell").agg(F.count(F.lit(1)).alias("n")).join(known, "cell", "left")
    share = F.sum(F.col("n") * F.coalesce("_known", F.lit(0.0))) / F.sum("n")
    n_stays = per_cell.groupBy("split").agg(F.sum("n").alias("n_stays"), share.alias("share_in_train_cells"))
    n_visits = visits.groupBy("split").agg(F.count(F.lit(1)).alias("n_visits"))
    names = points.sparkSession.createDataFrame([(n,) for n in NAMES], "split string")
    out = names
    for part in (per_trip, n_points, n_windows, n_stays, n_visits):
        out = out.join(part, "split", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select("split", *[zero(c) for c in ("n_users", "n_trips", "n_points", "n_windows", "n_stays", "n_visits")],
                      "share_in_train_cells")


def split_overlap(stays: DataFrame, grid: SquareGrid) -> DataFrame:
    """Shares of test stays in training cells and of test users in training, cell counts, and how far
    unseen test stays lie from the nearest training cell. One row."""
    train, test = stays.filter("split = 'train'"), stays.filter("split = 'test'")
    cells = train.select("cell").distinct()
    users = train.select("user_id").distinct().withColumn("_u", F.lit(1.0))
    inside = test.join(cells.withColumn("_c", F.lit(1.0)), "cell", "left")
    one = F.lit(1).alias("_one")
    a = inside.agg(F.avg(F.coalesce("_c", F.lit(0.0))).alias("test_stays_in_train_cells"),
                   F.count_distinct("cell").alias("test_cells"))
    b = cells.agg(F.count(F.lit(1)).alias("train_cells"))
    c = test.select("user_id").distinct().join(users, "user_id", "left").agg(
        F.avg(F.coalesce("_u", F.lit(0.0))).alias("test_users_in_train"))
    clat, clon = grid.centroid(F.col("cell"))
    centres = cells.select("cell", clat.alias("lat"), clon.alias("lon"))
    unseen = inside.filter("_c is null").select(F.concat_ws("@", "user_id", F.col("t_arrive").cast("string")).alias("stay"), "lat", "lon")
    snaps = nearest(unseen, centres, "stay", "cell", grid.lat0, grid.lon0)
    s = exact_percentiles(snaps, [], "dist_m", {"median_snap_m": 0.5, "p95_snap_m": 0.95})
    out = a.select("*", one)
    for part in (b, c, s):
        out = out.join(part.select("*", one), "_one", "left")
    return out.drop("_one")


def split_view(view: DataFrame, split: str, key: str, cap: int, seed: int = 0) -> DataFrame:
    """A capped sample of another split in the place of the test split."""
    rows = view.filter(F.col("split") == split)
    return seeded_subset(rows, key, cap, seed, "eval").withColumn("split", F.lit("test"))
