"""Schemas at the boundaries and the checks made on them."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT_COLUMNS = ("user_id", "traj_id", "t", "lat", "lon")

POINTS = T.StructType([
    T.StructField("user_id", T.StringType()), T.StructField("traj_id", T.StringType()),
    T.StructField("t", T.DoubleType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()),
    T.StructField("mode", T.StringType()), T.StructField("split", T.StringType())])

RESULTS = T.StructType([
    *[T.StructField(n, T.StringType()) for n in
      ("model", "run_tag", "family", "task", "metric", "protocol", "dataset", "unit", "baseline")],
    *[T.StructField(n, T.DoubleType()) for n in
      ("value", "ci_low", "ci_high", "baseline_value", "skill", "skill_ci_low", "skill_ci_high")],
    T.StructField("n", T.LongType()), T.StructField("eval_seed", T.LongType()),
    T.StructField("higher_is_better", T.BooleanType()), T.StructField("paper_match", T.StringType()),
    T.StructField("flags", T.ArrayType(T.StringType()))])


def require_columns(df: DataFrame, columns=POINT_COLUMNS) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"points table lacks columns {missing}; it has {df.columns}")


def validate_points(df: DataFrame) -> DataFrame:
    """One row of violation counts, aggregated in a single pass."""
    require_columns(df)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    lat, lon = F.col("lat"), F.col("lon")
    missing = F.col("t").isNull() | lat.isNull() | lon.isNull() | F.isnan("lat") | F.isnan("lon")
    return df.agg(F.count(F.lit(1)).alias("n_points"), count(missing).alias("n_missing"),
                  count((lat < -90) | (lat > 90)).alias("n_bad_lat"),
                  count((lon < -180) | (lon > 180)).alias("n_bad_lon"),
                  count((lat == 0) & (lon == 0)).alias("n_null_island"))
