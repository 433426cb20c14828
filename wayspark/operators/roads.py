"""Road networks: segments between intersections, directed edges and bounded routes."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_M, haversine_m
from ..functions.ordered import global_rank
from ..functions.tiles import tile_routes
from ..session import cut_lineage

# Road classes open to cars.
DRIVABLE = ("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "motorway_link", "trunk_link",
            "primary_link", "secondary_link", "tertiary_link", "living_street", "road")


def drivable_nodes(way_nodes: DataFrame, bbox: tuple[float, float, float, float] | None = None, classes=DRIVABLE) -> DataFrame:
    """Nodes of drivable ways in travel order with ``oneway``. A way stays if one node is in the box.

    One-way by tag, for motorways and in roundabouts; '-1' reverses the way, 'no' overrules.
    """
    rows = way_nodes.filter(F.col("highway").isin(*classes))
    tag = F.coalesce("oneway", F.lit(""))
    forced = tag.isin("yes", "true", "1", "-1") | F.col("highway").isin("motorway", "motorway_link") | (F.coalesce("junction", F.lit("")) == "roundabout")
    rows = rows.withColumns({"oneway": forced & (tag != "no"), "seq": F.when(tag == "-1", -F.col("seq")).otherwise(F.col("seq"))})
    if bbox is not None:
        a0, a1, o0, o1 = bbox
        inside = rows.filter(F.col("lat").between(a0, a1) & F.col("lon").between(o0, o1)).select("way").distinct()
        rows = rows.join(inside, "way", "left_semi")
    return rows.select("way", "seq", "node", "lat", "lon", "oneway")


def segment_ways(way_nodes: DataFrame, bbox=None, classes=DRIVABLE) -> DataFrame:
    """Segments between intersections: (seg_id, way, u, v, oneway, length_m, geom).

    A node weighs two where a way ends and one inside it; ways are cut at inner nodes of weight >= 2.
    """
    w = Window.partitionBy("way")
    nodes = drivable_nodes(way_nodes, bbox, classes).withColumns({
        "_first": F.min("seq").over(w), "_last": F.max("seq").over(w), "_n": F.count(F.lit(1)).over(w)}).filter("_n >= 2")
    end = (F.col("seq") == F.col("_first")) | (F.col("seq") == F.col("_last"))
    nodes = nodes.withColumn("_end", end)
    weight = nodes.groupBy("node").agg(F.sum(F.when(F.col("_end"), 2).otherwise(1)).alias("_k"))
    marked = nodes.join(weight, "node").withColumn("_cut", (~F.col("_end") & (F.col("_k") >= 2)).cast("int"))
    marked = marked.withColumn("_piece", F.sum("_cut").over(w.orderBy("seq")))
    # a cut node closes one piece and opens the next
    both = F.when(F.col("_cut") == 1, F.array(F.col("_piece") - 1, F.col("_piece"))).otherwise(F.array("_piece"))
    rows = marked.withColumn("piece", F.explode(both))
    p = Window.partitionBy("way", "piece").orderBy("seq")
    rows = rows.withColumn("_d", haversine_m(F.lag("lat").over(p), F.lag("lon").over(p), F.col("lat"), F.col("lon")))
    geom = F.sort_array(F.collect_list(F.struct("seq", "lat", "lon")))
    segs = rows.groupBy("way", "piece").agg(F.min_by("node", "seq").alias("u"), F.max_by("node", "seq").alias("v"), F.first("oneway").alias("oneway"),
                                            F.coalesce(F.sum("_d"), F.lit(0.0)).alias("length_m"), geom.alias("_g"))
    segs = segs.withColumn("geom", F.transform("_g", lambda g: F.struct(g["lat"].alias("lat"), g["lon"].alias("lon")))).drop("_g")
    ranked = global_rank(segs, ["way", "piece"], "_r")
    return ranked.select((F.col("_r") - 1).alias("seg_id"), "way", "piece", "u", "v", "oneway", "length_m", "geom")


def directed_edges(segments: DataFrame, length: str = "length_m") -> DataFrame:
    """Travel edges (a, b, w): both ways unless one-way; of parallel edges the shorter one."""
    ahead = segments.select(F.col("u").alias("a"), F.col("v").alias("b"), F.col(length).alias("w"))
    back = segments.filter("not oneway").select(F.col("v").alias("a"), F.col("u").alias("b"), F.col(length).alias("w"))
    return ahead.unionByName(back).groupBy("a", "b").agg((F.min("w") + 1e-6).alias("w"))


def located_edges(segments: DataFrame, length: str = "length_m") -> DataFrame:
    """``directed_edges`` with the positions of both ends: (a, b, w, a_lat, a_lon, b_lat, b_lon)."""
    ends = segments.select("u", "v", "oneway", F.col(length).alias("w"), F.element_at("geom", 1).alias("s"), F.element_at("geom", -1).alias("e"))
    way = lambda rows, a, b, s, e: rows.select(F.col(a).alias("a"), F.col(b).alias("b"), "w", *[F.col(f"{p}.{c}").alias(f"{n}_{c}") for p, n in ((s, "a"), (e, "b")) for c in ("lat", "lon")])
    both = way(ends, "u", "v", "s", "e").unionByName(way(ends.filter("not oneway"), "v", "u", "e", "s"))
    return both.groupBy("a", "b").agg((F.min("w") + 1e-6).alias("w"), *[F.first(c).alias(c) for c in ("a_lat", "a_lon", "b_lat", "b_lon")])


def bounded_routes(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Shortest distances (source, node, d) up to each source's own limit: ``edges`` as of ``located_edges``, ``sources`` (node, limit_m).

    Tile-local heap searches (``functions/tiles.py``) with tiles of earth-centred coordinates: a chord is never longer than the
    way along the ground, wherever the network lies. A source without edges reaches itself.
    """
    chord = lambda p: {f"{p}_x": EARTH_RADIUS_M * F.cos(F.radians(f"{p}_lat")) * F.cos(F.radians(f"{p}_lon")),
                       f"{p}_y": EARTH_RADIUS_M * F.cos(F.radians(f"{p}_lat")) * F.sin(F.radians(f"{p}_lon")), f"{p}_z": EARTH_RADIUS_M * F.sin(F.radians(f"{p}_lat"))}
    edges = cut_lineage(edges.withColumns({**chord("a"), **chord("b")}).drop("a_lat", "a_lon", "b_lat", "b_lon"))
    at = lambda p: F.struct(F.col(p).alias("node"), *[F.col(f"{p}_{c}").alias(f"s_{c}") for c in "xyz"])
    places = edges.select(F.explode(F.array(at("a"), at("b"))).alias("p")).select("p.*").groupBy("node").agg(*[F.first(f"s_{c}").alias(f"s_{c}") for c in "xyz"])
    start = sources.groupBy("node").agg(F.max("limit_m").cast("double").alias("limit_m")).join(places, "node", "left").withColumnRenamed("node", "source")
    return tile_routes(edges, cut_lineage(start), ["x", "y", "z"]).select("source", "node", "d")
