"""Location label spaces: square grid, hexagons, region vocabularies and nearest-cell snapping."""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import METRES_PER_DEGREE, Y_SCALE, to_latlon, to_xy, x_scale
from ..functions.ordered import exact_percentiles, global_rank
from ..session import cut_lineage, partitions


def _clip(c: Column, hi: int) -> Column:
    return F.when(c < 0, F.lit(0)).when(c > hi, F.lit(hi)).otherwise(c)


@dataclass(frozen=True)
class SquareGrid:
    """Padded bounding box cut into square metric cells; cell = iy * nx + ix, clipped to the border.

    The parameters come from one aggregated row and enter every plan as literals.
    """
    lat0: float
    lon0: float
    x0: float
    y0: float
    nx: int
    ny: int
    cell_m: float

    @classmethod
    def fit(cls, points: DataFrame, cell_m: float = 500.0, pad_m: float = 1000.0) -> SquareGrid:
        r = points.agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon"), F.avg("lat")).first()
        pad_lat, pad_lon = pad_m / METRES_PER_DEGREE, pad_m / (METRES_PER_DEGREE * math.cos(math.radians(r[4])))
        return cls.from_bounds(r[0] - pad_lat, r[1] + pad_lat, r[2] - pad_lon, r[3] + pad_lon, cell_m)

    @classmethod
    def from_bounds(cls, lat_lo, lat_hi, lon_lo, lon_hi, cell_m: float) -> SquareGrid:
        lat0, lon0 = (lat_lo + lat_hi) / 2, (lon_lo + lon_hi) / 2
        kx = x_scale(lat0)
        x0, y0 = (lon_lo - lon0) * kx, (lat_lo - lat0) * Y_SCALE
        x1, y1 = (lon_hi - lon0) * kx, (lat_hi - lat0) * Y_SCALE
        return cls(lat0, lon0, x0, y0, int((x1 - x0) // cell_m) + 1, int((y1 - y0) // cell_m) + 1, float(cell_m))

    @property
    def n_cells(self) -> int:
        return self.nx * self.ny

    def cell(self, lat: Column, lon: Column) -> Column:
        x, y = to_xy(lat, lon, self.lat0, self.lon0)
        ix = _clip(F.floor((x - self.x0) / self.cell_m), self.nx - 1)
        iy = _clip(F.floor((y - self.y0) / self.cell_m), self.ny - 1)
        return (iy * self.nx + ix).cast("bigint")

    def centroid(self, cell: Column) -> tuple[Column, Column]:
        ix, iy = cell % self.nx, F.floor(cell / self.nx)
        return to_latlon(self.x0 + (ix + 0.5) * self.cell_m, self.y0 + (iy + 0.5) * self.cell_m, self.lat0, self.lon0)


def hex_cell(lat: Column, lon: Column, lat0: float, lon0: float, size_m: float) -> tuple[Column, Column]:
    """Axial (q, r) of the pointy-top hexagon that holds a point, by cube rounding."""
    x, y = to_xy(lat, lon, lat0, lon0)
    q = (math.sqrt(3.0) / 3.0 * x - y / 3.0) / size_m
    r = (2.0 / 3.0 * y) / size_m
    s = -q - r
    near = lambda v: F.floor(v + 0.5)
    dq, dr, ds = F.abs(near(q) - q), F.abs(near(r) - r), F.abs(near(s) - s)
    rq = F.when((dq > dr) & (dq > ds), -near(r) - near(s)).otherwise(near(q))
    rr = F.when((dq > dr) & (dq > ds), near(r)).when(dr > ds, -near(q) - near(s)).otherwise(near(r))
    return rq.cast("bigint"), rr.cast("bigint")


def hex_centre(q: Column, r: Column, lat0: float, lon0: float, size_m: float) -> tuple[Column, Column]:
    return to_latlon(size_m * (math.sqrt(3.0) * q + math.sqrt(3.0) / 2.0 * r), size_m * 1.5 * r, lat0, lon0)


def hex_vocabulary(places: DataFrame, lat0: float, lon0: float, size_m: float) -> DataFrame:
    """Occupied hexagons (of fixes and stays) with a dense id and their centre."""
    q, r = hex_cell(F.col("lat"), F.col("lon"), lat0, lon0, size_m)
    cells = places.select(q.alias("q"), r.alias("r")).distinct()
    lat, lon = hex_centre(F.col("q"), F.col("r"), lat0, lon0, size_m)
    ranked = global_rank(cells, ["q", "r"], "_rank")
    return ranked.select((F.col("_rank") - 1).alias("cell"), "q", "r", lat.alias("lat"), lon.alias("lon"))


# ------------------------------------------------------------------ nearest neighbour
LEAF = 512              # distinct targets of a leaf
SHARE = 50_000          # queries of a task's group
PAIRS = 1_000_000       # distances in memory


def nearest(queries: DataFrame, targets: DataFrame, key: str, target: str, lat0: float, lon0: float,
            leaf_m: float = 1000.0, levels: int = 4, fan: int = 8) -> DataFrame:
    """Exact nearest ``target`` of every query in projected metres: (key, target, dist_m).

    Equal positions are searched once on both sides. Targets form a tree of square tiles (side leaf_m * fan^level, leaves cut
    finer until they hold few targets) with tight bounds. The boxes of the queries of a leaf tile walk down from the root by
    equi-joins on the parent tile and keep only tiles whose nearest edge is not beyond the best distance guaranteed to all their
    queries. A task then compares the queries of neighbouring leaf tiles with the targets of the tiles that are left.
    """
    qx, qy = to_xy(F.col("lat"), F.col("lon"), lat0, lon0)
    q = queries.select(key, qx.alias("x"), qy.alias("y"))
    t = cut_lineage(targets.select(target, qx.alias("tx"), qy.alias("ty")).filter("tx is not null and ty is not null")
                    .groupBy("tx", "ty").agg(F.min(F.struct(target)).alias("b")).select("tx", "ty", f"b.{target}"))
    corner = lambda x, y, side: (F.floor(F.col(x) / side), F.floor(F.col(y) / side))
    while leaf_m > 1.0 and (t.groupBy(*corner("tx", "ty", leaf_m)).count().agg(F.max("count")).first()[0] or 0) > LEAF:
        leaf_m, levels = leaf_m / fan, levels + 1

    def tile(level: int, x="tx", y="ty"):
        return F.concat_ws(":", F.lit(level), *corner(x, y, leaf_m * fan ** level))

    for level in range(levels):
        t = t.withColumn(f"tile{level}", tile(level))
    t = t.withColumn(f"tile{levels}", F.lit("root"))
    # a position without a number lies as far from everything: its box bounds no other query
    lost = F.isnan("x") | F.isnan("y")
    places = q.select("x", "y").filter("x is not null and y is not null").distinct().withColumns(
        {"own": F.when(lost, F.lit("none")).otherwise(tile(0, "x", "y")), "block": F.when(lost, F.lit("none")).otherwise(tile(1, "x", "y"))})
    places = cut_lineage(places)
    boxes = places.groupBy("own", "block").agg(F.min("x").alias("qx0"), F.max("x").alias("qx1"), F.min("y").alias("qy0"), F.max("y").alias("qy1"))
    live = boxes.withColumn("tile", F.lit("root"))
    for level in range(levels - 1, -1, -1):
        tiles = t.groupBy(F.col(f"tile{level + 1}").alias("tile"), F.col(f"tile{level}").alias("child")).agg(
            F.min("tx").alias("x0"), F.max("tx").alias("x1"), F.min("ty").alias("y0"), F.max("ty").alias("y1"))
        # the top tiles are at most the earth's surface in squares of leaf_m * fan^(levels - 1)
        pairs = live.join(F.broadcast(tiles) if level == levels - 1 else tiles, "tile")
        out = lambda v: F.greatest(F.col(f"{v}0") - F.col(f"q{v}1"), F.col(f"q{v}0") - F.col(f"{v}1"), F.lit(0.0))
        far = lambda v: F.greatest(F.abs(F.col(f"q{v}0") - F.col(f"{v}1")), F.abs(F.col(f"q{v}1") - F.col(f"{v}0")))
        near2 = out("x") ** 2 + out("y") ** 2
        # some target lies in the tile, so it is no farther from any query than the far corners are
        far2 = far("x") ** 2 + far("y") ** 2
        bound = F.min("far2").over(Window.partitionBy("own"))
        live = pairs.withColumns({"near2": near2, "far2": far2}).withColumn("bound", bound) \
            .filter("near2 <= bound").select("own", "block", "qx0", "qx1", "qy0", "qy1", F.col("child").alias("tile"))
    live = cut_lineage(live.select("block", "tile").distinct())
    crowd = places.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("parts"))
    left = places.join(crowd, "block").select(F.col("block").alias("_block"), F.pmod(F.xxhash64("own", "x", "y"), F.col("parts")).cast("int").alias("_part"), "own", "x", "y")
    right = t.select(F.col("tile0").alias("tile"), target, "tx", "ty").join(live, "tile").join(crowd, "block") \
        .select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), target, "tx", "ty")

    def closest(asked: pa.Table, known: pa.Table) -> pa.Table:
        known = known.take(pc.sort_indices(known, sort_keys=[(target, "ascending")], null_placement="at_start"))    # ties go to the first
        tx, ty = (known.column(c).to_numpy() for c in ("tx", "ty"))
        x, y = (asked.column(c).to_numpy() for c in ("x", "y"))
        best = np.zeros(len(x), np.int64)
        own = asked.column("own").combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.argsort(own, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
            if not len(rows) or not len(tx):
                continue
            x0, x1, y0, y1 = x[rows].min(), x[rows].max(), y[rows].min(), y[rows].max()
            reach = np.maximum(np.abs(x0 - tx), np.abs(x1 - tx)) ** 2 + np.maximum(np.abs(y0 - ty), np.abs(y1 - ty)) ** 2
            gap = np.maximum(np.maximum(x0 - tx, tx - x1), 0.0) ** 2 + np.maximum(np.maximum(y0 - ty, ty - y1), 0.0) ** 2
            some = np.flatnonzero(~(gap > np.nanmin(reach))) if not np.isnan(reach).all() else np.arange(len(tx))
            step = max(1, PAIRS // len(some))
            for lo in range(0, len(rows), step):
                r = rows[lo:lo + step]
                d2 = (x[r, None] - tx[some]) ** 2 + (y[r, None] - ty[some]) ** 2
                best[r] = some[np.where(np.isnan(d2), np.inf, d2).argmin(1)]
        if not len(tx):
            asked, best, x, y = asked.slice(0, 0), best[:0], x[:0], y[:0]
        d2 = (x - tx[best]) ** 2 + (y - ty[best]) ** 2
        return pa.table([asked.column("x"), asked.column("y"), pa.array(d2), known.column(target).take(pa.array(best))], names=["x", "y", "d2", target])

    schema = f"x double, y double, d2 double, {target} {t.schema[target].dataType.simpleString()}"
    tasks = partitions(q.sparkSession)
    left, right = left.repartition(tasks, "_block", "_part"), right.repartition(tasks, "block", "part")
    found = left.groupBy("_block", "_part").cogroup(right.groupBy("block", "part")).applyInArrow(closest, schema)
    best = q.join(found, ["x", "y"]).groupBy(key).agg(F.min(F.struct("d2", target)).alias("b"))
    return best.select(key, F.col(f"b.{target}").alias(target), F.sqrt("b.d2").alias("dist_m"))


# ------------------------------------------------------------------ vocabularies
def region_vocabulary(train_cells: DataFrame, cell: str = "cell", first_token: int = 4) -> DataFrame:
    """Distinct training cells in order; token = position + ``first_token`` (special tokens come first)."""
    ranked = global_rank(train_cells.select(cell).distinct(), [cell], "_rank")
    return ranked.select(cell, (F.col("_rank") - 1 + first_token).alias("token"))


def tokenize(places: DataFrame, vocabulary: DataFrame, grid: SquareGrid, key: str) -> DataFrame:
    """Token of every place; a cell unknown to training takes the token of the nearest known centroid
    (``snap_m`` is how far that was)."""
    own = places.withColumn("cell", grid.cell(F.col("lat"), F.col("lon")))
    direct = own.join(vocabulary, "cell", "left")
    clat, clon = grid.centroid(F.col("cell"))
    centres = vocabulary.withColumns({"lat": clat, "lon": clon})
    missing = direct.filter("token is null").select(key, "lat", "lon")
    snapped = nearest(missing, centres, key, "token", grid.lat0, grid.lon0).withColumnsRenamed(
        {"token": "_token", "dist_m": "snap_m"})
    return direct.join(snapped, key, "left").withColumn("token", F.coalesce("token", "_token")).drop("_token")


def snap_statistics(tokens: DataFrame, warn_m: float = 2000.0) -> DataFrame:
    """Number, median, p95 and maximum of the snapping distances, and whether to warn."""
    one = F.lit(1).alias("_one")
    counts = tokens.agg(F.count("snap_m").alias("n_snapped"), F.max("snap_m").alias("max_m"))
    quantiles = exact_percentiles(tokens, [], "snap_m", {"median_m": 0.5, "p95_m": 0.95})
    both = counts.select("*", one).join(quantiles.select("*", one), "_one", "left").drop("_one")
    return both.withColumn("warn", F.coalesce(F.col("p95_m") > warn_m, F.lit(False)))


@dataclass(frozen=True)
class RegionGrid:
    """Equal-degree cells over the study area; id = 1 + ix * ny + iy."""
    lat0: float
    lon0: float
    dlat: float
    dlon: float
    nx: int
    ny: int

    @classmethod
    def fit(cls, points: DataFrame, n: int = 16, cell_m: float | None = None) -> RegionGrid:
        r = points.agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
        k = math.cos(math.radians((r[0] + r[1]) / 2))
        height, width = (r[1] - r[0]) * METRES_PER_DEGREE, (r[3] - r[2]) * METRES_PER_DEGREE * k
        if cell_m is None:
            cell_m, nx, ny = max(height, width) / n * (1 + 1e-9), n, n
        else:
            nx, ny = int(width // cell_m) + 1, int(height // cell_m) + 1
        return cls(r[0], r[2], cell_m / METRES_PER_DEGREE, cell_m / (METRES_PER_DEGREE * k), nx, ny)

    def raw_id(self, lat: Column, lon: Column) -> Column:
        ix = _clip(F.floor((lon - self.lon0) / self.dlon), self.nx - 1)
        iy = _clip(F.floor((lat - self.lat0) / self.dlat), self.ny - 1)
        return (1 + ix * self.ny + iy).cast("bigint")

    def ids(self, df: DataFrame, train: DataFrame | None = None, vocabulary: int | None = None, name: str = "region") -> DataFrame:
        """Region id per row: the cell's own number, or, where the caller asks for a ``vocabulary``, 1..V for the most
        frequent training cells and V + 1 for every other one."""
        out = df.withColumn(name, self.raw_id(F.col("lat"), F.col("lon")))
        if vocabulary is None:
            return out
        vocab = frequency_vocabulary(train.withColumn(name, self.raw_id(F.col("lat"), F.col("lon"))), name, vocabulary)
        return encode(out, vocab, name, vocab.count() + 1)


def frequency_vocabulary(df: DataFrame, column: str, size: int | None = None) -> DataFrame:
    """Values by frequency, numbered from 1 (ties by value): all, or the ``size`` most frequent. The rank is the distributed
    one, so no task sorts the vocabulary."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    ranked = global_rank(counts.withColumn("_neg", -F.col("n")), ["_neg", column], "index").drop("_neg")
    return ranked if size is None else ranked.filter(F.col("index") <= size)


def encode(df: DataFrame, vocabulary: DataFrame, column: str, unknown: int) -> DataFrame:
    codes = vocabulary.select(column, F.col("index").alias("_code"))
    return df.join(codes, column, "left").withColumn(column, F.coalesce("_code", F.lit(unknown)).cast("bigint")).drop("_code")


def road_vocabulary(matched: DataFrame, max_roads: int | None = None) -> DataFrame:
    """Segments matched in training by frequency, 1..R; -1 (unmatched) is no road."""
    return frequency_vocabulary(matched.filter("seg >= 0"), "seg", max_roads)


def category_vocabulary(features: DataFrame, dim: int) -> DataFrame:
    """The ``dim - 1`` most frequent categories at 0..; all others share index ``dim - 1``."""
    return frequency_vocabulary(features, "category", dim - 1).select("category", (F.col("index") - 1).alias("index"), "n")
