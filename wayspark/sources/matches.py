"""Map-matching tables and the file exchange with an external matcher."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import global_rank
from ..operators.prep import _placed


def write_matches(matches: DataFrame, path: str) -> None:
    rows = matches.select("traj_id", "t", "seg")
    if path.endswith(".csv"):
        rows.write.mode("overwrite").option("header", True).csv(path)
    else:
        rows.write.mode("overwrite").parquet(path)


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".csv"):
        return spark.read.option("header", True).schema("traj_id string, t double, seg bigint").csv(path)
    return spark.read.parquet(path).select("traj_id", "t", F.col("seg").cast("bigint"))


def trip_numbers(points: DataFrame) -> DataFrame:
    """Dense number of every trajectory in id order (from 0)."""
    ranked = global_rank(points.select("traj_id").distinct(), ["traj_id"], "_r")
    return ranked.select("traj_id", (F.col("_r") - 1).alias("id"))


def export_points(points: DataFrame, path: str) -> DataFrame:
    """Writes ``id;x;y;timestamp`` and returns the trip numbers."""
    ids = trip_numbers(points)
    rows = points.join(ids, "traj_id").select("id", F.col("lon").alias("x"), F.col("lat").alias("y"), F.col("t").alias("timestamp"))
    rows.repartitionByRange("id", "timestamp").sortWithinPartitions("id", "timestamp").write.mode("overwrite").option("sep", ";").option("header", True).csv(path)
    return ids


def import_paths(points: DataFrame, path: str, edges: DataFrame) -> DataFrame:
    """(traj_id, t, seg) from ``id;opath`` (one edge per fix). A path of the wrong length leaves its
    trip unmatched; ``edges``: (edge, seg); trips without a result are absent."""
    spark = points.sparkSession
    rows = spark.read.option("sep", ";").option("header", True).csv(path).select(F.col("id").cast("bigint"), F.filter(F.split("opath", ","), lambda x: F.trim(x) != "").alias("op"))
    trips = trip_numbers(points)
    sizes = points.groupBy("traj_id").agg(F.count(F.lit(1)).alias("n"))
    known = rows.join(trips, "id").join(sizes, "traj_id").withColumn("ok", F.size("op") == F.col("n"))
    steps = known.filter("ok").select("traj_id", F.posexplode("op").alias("i", "edge")).select("traj_id", (F.col("i") + 1).cast("bigint").alias("i"), F.col("edge").cast("bigint"))
    seg = steps.join(edges, "edge", "left").select("traj_id", "i", "seg")
    fixes = _placed(points.select("traj_id", "t")).withColumn("i", F.col("p") + 1).join(known.select("traj_id"), "traj_id", "left_semi")
    return fixes.join(seg, ["traj_id", "i"], "left").select("traj_id", "t", F.coalesce("seg", F.lit(-1)).cast("bigint").alias("seg"))
