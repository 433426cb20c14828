"""Points of interest and road lines as (lat, lon, category)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from .tables import read_table

# Tag keys that give a category, in order of preference.
POI_KEYS = ("amenity", "shop", "tourism", "leisure", "office", "healthcare", "public_transport", "railway", "aeroway", "craft", "historic", "emergency")
ROAD_KEYS = ("highway",)

_FEATURE = "struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"


def category_of(value, keys) -> Column:
    """'key=value' of the first key with a usable value, else 'other'. ``value``: key -> column."""
    usable = lambda k: F.when(~F.lower(F.coalesce(value(k), F.lit(""))).isin("", "nan", "none"), F.concat(F.lit(f"{k}="), value(k)))
    return F.coalesce(*[usable(k) for k in keys], F.lit("other"))


def _vertices(kind: Column, text: Column) -> Column:
    """ARRAY<ARRAY<DOUBLE>> of all (lon, lat) pairs of a geometry, whatever its nesting."""
    d1, d2 = F.array(F.from_json(text, "array<double>")), F.from_json(text, "array<array<double>>")
    d3 = F.flatten(F.from_json(text, "array<array<array<double>>>"))
    d4 = F.flatten(F.flatten(F.from_json(text, "array<array<array<array<double>>>>")))
    return F.when(kind == "Point", d1).when(kind.isin("LineString", "MultiPoint"), d2) \
        .when(kind.isin("Polygon", "MultiLineString"), d3).when(kind == "MultiPolygon", d4)


def read_features(spark: SparkSession, path: str, keys=POI_KEYS, lat: str = "lat", lon: str = "lon", category: str | None = None,
                  spacing_m: float | None = None, one_per_line: bool = False) -> DataFrame:
    """GeoJSON (a collection, or one feature per line so that big files stay splittable), CSV or Parquet.

    Lines and areas become the mean of their vertices, or points at most ``spacing_m`` apart.
    """
    if not path.rstrip("/").endswith((".geojson", ".json")):
        df = read_table(spark, path)
        missing = [c for c in (lat, lon) if c not in df.columns]
        if missing:
            raise ValueError(f"columns {missing} not found; available: {df.columns}")
        present = [k for k in keys if k in df.columns]
        cat = F.col(category).cast("string") if category and category in df.columns else category_of(lambda k: F.col(k).cast("string"), present) \
            if present else F.lit("other")
        return df.select(F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"), cat.alias("category"))
    if one_per_line:
        features = spark.read.schema(_FEATURE[7:-1].replace("properties:", "properties ", 1).replace(",geometry:", ", geometry ", 1)).json(path)
    else:
        features = spark.read.schema(f"features array<{_FEATURE}>").option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.*")
    cat = F.coalesce(F.col("properties")[category], F.lit("other")) if category else category_of(lambda k: F.col("properties")[k], keys)
    shapes = features.select(F.monotonically_increasing_id().alias("id"), cat.alias("category"), _vertices(F.col("geometry.type"), F.col("geometry.coordinates")).alias("v"))
    shapes = shapes.filter(F.size("v") > 0)
    mean = lambda i: F.aggregate("v", F.lit(0.0), lambda a, p: a + p[i]) / F.size("v")
    if spacing_m is None:
        return shapes.select(mean(1).alias("lat"), mean(0).alias("lon"), "category")
    single = shapes.filter(F.size("v") == 1).select(mean(1).alias("lat"), mean(0).alias("lon"), "category")
    points = shapes.filter(F.size("v") > 1).select("id", "category", F.posexplode("v").alias("pos", "p")) \
        .select("id", "category", "pos", F.col("p")[1].alias("lat"), F.col("p")[0].alias("lon"))
    return single.unionByName(sample_lines(points, "id", spacing_m, ["category"]).select("lat", "lon", "category"))


def sample_lines(vertices: DataFrame, key: str, spacing_m: float, carry: list[str] | None = None) -> DataFrame:
    """Points along each line, at most ``spacing_m`` apart, at (k + 1/2) of n equal parts.

    Every piece between two vertices produces the points that fall on it, so the join of a point with
    its piece is an explode. ``vertices``: (key, pos, lat, lon) and the columns of ``carry``, which are one for a line; lines have few vertices.
    """
    from pyspark.sql import Window
    w = Window.partitionBy(key).orderBy("pos")
    v = vertices.withColumns({"_la": F.lag("lat").over(w), "_lo": F.lag("lon").over(w)})
    v = v.withColumn("_d", haversine_m(F.col("_la"), F.col("_lo"), F.col("lat"), F.col("lon")))
    v = v.withColumns({"_to": F.coalesce(F.sum("_d").over(w), F.lit(0.0)), "_total": F.coalesce(F.sum("_d").over(Window.partitionBy(key)), F.lit(0.0))})
    n = F.greatest(F.ceil(F.col("_total") / spacing_m), F.lit(1))
    v = v.withColumns({"_n": n, "_from": F.col("_to") - F.col("_d")})
    part = F.col("_total") / F.col("_n")
    first, last = F.ceil(F.col("_from") / part - 0.5), F.ceil(F.col("_to") / part - 0.5) - 1
    last = F.least(F.when(F.abs(F.col("_to") - F.col("_total")) < 1e-9, F.col("_n") - 1).otherwise(last), F.col("_n") - 1)
    first = F.greatest(first, F.lit(0))
    on = v.filter((F.col("_d") > 0) & (F.col("_total") > 0)).withColumn("k", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    f = (((F.col("k") + 0.5) * F.col("_total") / F.col("_n")) - F.col("_from")) / F.col("_d")
    line = on.select(key, *(carry or []), "k", (F.col("_la") + f * (F.col("lat") - F.col("_la"))).alias("lat"), (F.col("_lo") + f * (F.col("lon") - F.col("_lo"))).alias("lon"))
    # a line without length is its first vertex
    flat = v.filter((F.col("_total") <= 0) & F.col("_la").isNull()).select(key, *(carry or []), F.lit(0).cast("bigint").alias("k"), "lat", "lon")
    return line.unionByName(flat)
