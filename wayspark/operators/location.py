"""Next location: sparse baselines fitted on training visits, ranking and distance metrics.

A dense (samples x cells) score matrix is never built. Ranks are counted from sparse scores, and
what all unscored cells share (popularity, smoothing) is added analytically.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from ..session import cut_lineage
from .grid import SquareGrid
from .scores import melt

RANK_RULE = "rank = number of strictly better cells + number of equal ones, the true cell included"


class LocationBaselines:
    """Counts of training visits: ``popularity`` per cell and ``transitions`` last -> next cell.

    Popularity smooths with alpha per grid cell, which needs only the number of cells.
    """

    def __init__(self, train: DataFrame, n_cells: int, alpha: float = 0.1):
        self.n_cells, self.alpha = n_cells, alpha
        pairs = train.select(F.element_at("ctx", -1)["cell"].alias("last"), F.col("tgt.cell").alias("cell"))
        # counts per pair of cells: read by every baseline, so written once
        self.transitions = cut_lineage(pairs.groupBy("last", "cell").agg(F.count(F.lit(1)).alias("m")))
        both = self.transitions.select(F.explode(F.array("last", "cell")).alias("cell"), "m")
        self.popularity = cut_lineage(both.groupBy("cell").agg(F.sum("m").alias("cnt")))
        row = self.popularity.agg(F.sum("cnt"), F.count(F.lit(1)), F.min_by("cell", F.struct(-F.col("cnt"), F.col("cell")))).first()
        self.total, self.seen, self.top_cell = row[0] or 0, row[1], row[2] if row[2] is not None else 0
        # cells with a count of at least each count that occurs
        levels = self.popularity.groupBy("cnt").agg(F.count(F.lit(1)).alias("k"))
        w = Window.orderBy(F.desc("cnt")).rowsBetween(Window.unboundedPreceding, 0)
        self.at_least = levels.select("cnt", F.sum("k").over(w).alias("pop_rank"))    # few distinct counts

    def pop(self, cnt: Column) -> Column:
        return (cnt + self.alpha) / (self.total + self.alpha * self.n_cells)

    def targets(self, visits: DataFrame) -> DataFrame:
        """Samples with the popularity count and rank of the true cell."""
        v = visits.select("sample_id", "user_id", "ctx", F.element_at("ctx", -1)["cell"].alias("last"),
                          F.col("tgt.cell").alias("cell"), F.col("tgt.lat").alias("lat"), F.col("tgt.lon").alias("lon"))
        v = v.join(self.popularity, "cell", "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
        return v.join(self.at_least, "cnt", "left").withColumn("pop_rank", F.coalesce("pop_rank", F.lit(self.n_cells)))

    def global_popular(self, visits: DataFrame) -> DataFrame:
        return self.targets(visits).select("sample_id", "cell", "lat", "lon", F.col("pop_rank").alias("rank"),
                                           self.pop(F.col("cnt")).alias("p"), F.lit(self.top_cell).cast("bigint").alias("top"))

    def user_frequent(self, visits: DataFrame) -> DataFrame:
        """Context counts, then popularity: a cell of the context always beats one outside it."""
        t = self.targets(visits).withColumn("n_ctx", F.size("ctx"))
        seen = t.select("sample_id", F.explode("ctx.cell").alias("c")).groupBy("sample_id", "c").agg(F.count(F.lit(1)).alias("n"))
        seen = seen.join(self.popularity.withColumnsRenamed({"cell": "c", "cnt": "c_cnt"}), "c", "left") \
            .withColumn("c_cnt", F.coalesce("c_cnt", F.lit(0)))
        j = t.drop("ctx").join(seen, "sample_id")
        own = F.max(F.when(F.col("c") == F.col("cell"), F.col("n"))).over(Window.partitionBy("sample_id"))
        j = j.withColumn("own", F.coalesce(own, F.lit(0)))
        better = (F.col("n") > F.col("own")) | ((F.col("n") == F.col("own")) & (F.col("c_cnt") >= F.col("cnt")))
        popular = F.sum(F.when(F.col("c_cnt") >= F.col("cnt"), 1).otherwise(0))
        g = j.groupBy("sample_id", "cell", "lat", "lon", "cnt", "pop_rank", "n_ctx", "own").agg(
            F.sum(F.when(better, 1).otherwise(0)).alias("in_ctx"), F.count(F.lit(1)).alias("k"), popular.alias("k_pop"),
            F.min_by("c", F.struct(-F.col("n"), -F.col("c_cnt"), F.col("c"))).alias("top"))
        rank = F.when(F.col("own") > 0, F.col("in_ctx")).otherwise(F.col("k") + F.col("pop_rank") - F.col("k_pop"))
        p = (F.col("own") + 1e-3 * self.pop(F.col("cnt"))) / (F.col("n_ctx") + 1e-3)
        return g.select("sample_id", "cell", "lat", "lon", rank.alias("rank"), p.alias("p"), "top")

    def markov1(self, visits: DataFrame) -> DataFrame:
        """Transition counts from the last cell, then popularity; an unseen last cell falls back to it."""
        row = self.transitions.join(self.popularity, "cell")
        w = Window.partitionBy("last")
        order = w.orderBy(F.desc("m"), F.desc("cnt")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = row.withColumn("row_rank", F.count(F.lit(1)).over(order))
        totals = row.groupBy("last").agg(F.sum("m").alias("row_total"), F.count(F.lit(1)).alias("row_size"),
                                         F.min_by("cell", F.struct(-F.col("m"), -F.col("cnt"), F.col("cell"))).alias("row_top"))
        t = self.targets(visits).drop("ctx")
        t = t.join(totals, "last", "left").join(ranked.select("last", "cell", "m", "row_rank"), ["last", "cell"], "left")
        # how many targets of the row are at least as popular as the true cell: distinct (last, count)
        # pairs are merged into the row's popularity order, never paired with its targets
        asked = t.select("last", "cnt").distinct().select("last", "cnt", F.lit(0).alias("k"))
        have = row.groupBy("last", "cnt").agg(F.count(F.lit(1)).alias("k"))
        both = have.unionByName(asked).groupBy("last", "cnt").agg(F.sum("k").alias("k"))
        upto = w.orderBy(F.desc("cnt")).rowsBetween(Window.unboundedPreceding, 0)
        popular = both.select("last", "cnt", F.sum("k").over(upto).alias("k_pop"))
        t = t.join(popular, ["last", "cnt"])
        known = F.col("row_total").isNotNull()
        rank = F.when(~known, F.col("pop_rank")).when(F.col("m").isNotNull(), F.col("row_rank")) \
            .otherwise(F.col("row_size") + F.col("pop_rank") - F.col("k_pop"))
        p = F.when(known, (F.coalesce("m", F.lit(0)) + 1e-2 * self.pop(F.col("cnt"))) / (F.col("row_total") + 1e-2)) \
            .otherwise(self.pop(F.col("cnt")))
        return t.select("sample_id", "cell", "lat", "lon", rank.alias("rank"), p.alias("p"),
                        F.coalesce("row_top", F.lit(self.top_cell)).cast("bigint").alias("top"))


# ------------------------------------------------------------------ scores of a model
def normalise(scores: DataFrame, value: str = "score", key: str = "sample_id") -> DataFrame:
    """Probabilities from sparse scores: kept if every sample's already sum to one, else softmax over
    the scored items."""
    sums = scores.groupBy(key).agg(F.sum(value).alias("s"), F.min(value).alias("lo"))
    ok = sums.agg(F.coalesce(F.bool_and((F.col("lo") >= 0) & (F.abs(F.col("s") - 1) <= 1e-3)), F.lit(False))).first()[0]
    if ok:
        return scores.join(sums.select(key, "s"), key).withColumn("p", F.col(value) / F.col("s")).drop("s")
    top = scores.groupBy(key).agg(F.max(value).alias("_m"))
    e = scores.join(top, key).withColumn("_e", F.exp(F.col(value) - F.col("_m")))
    total = e.groupBy(key).agg(F.sum("_e").alias("_z"))
    return e.join(total, key).withColumn("p", F.col("_e") / F.col("_z")).drop("_m", "_e", "_z")


def rank_scores(probs: DataFrame, visits: DataFrame, n_cells: int) -> DataFrame:
    """Rank, probability and top cell from sparse (sample_id, cell, p); unscored cells have p = 0.

    Each scored row is compared with its own sample's true score: one join on the sample, then a
    combined count; if the true cell has no score, all unscored cells tie with it.
    """
    t = visits.select("sample_id", F.col("tgt.cell").alias("true_cell"), F.col("tgt.lat").alias("lat"), F.col("tgt.lon").alias("lon"))
    own = probs.join(t.select("sample_id", F.col("true_cell").alias("cell")), ["sample_id", "cell"]).select("sample_id", F.col("p").alias("p_true"))
    base = t.join(own, "sample_id", "left").withColumn("p_true", F.coalesce("p_true", F.lit(0.0)))
    j = base.join(probs.filter("p > 0"), "sample_id", "left")
    g = j.groupBy("sample_id", "true_cell", "lat", "lon", "p_true").agg(
        F.sum(F.when(F.col("p") >= F.col("p_true"), 1).otherwise(0)).alias("ge"),
        F.count("p").alias("scored"), F.min_by("cell", F.struct(-F.col("p"), F.col("cell"))).alias("top"))
    rank = F.when(F.col("p_true") > 0, F.col("ge")).otherwise(F.lit(n_cells))
    return g.select("sample_id", F.col("true_cell").alias("cell"), "lat", "lon", rank.cast("bigint").alias("rank"),
                    F.col("p_true").alias("p"), F.coalesce("top", F.lit(0)).alias("top"))


def tokens_to_cells(token_probs: DataFrame, tokens: DataFrame, grid: SquareGrid) -> tuple[DataFrame, DataFrame]:
    """Own-token probabilities on the shared grid: mass summed per cell of the token's centroid; the
    top-1 place is the centroid of the best token. ``tokens``: (token, lat, lon)."""
    placed = tokens.withColumn("cell", grid.cell(F.col("lat"), F.col("lon")))
    j = token_probs.join(placed, "token")
    cells = j.groupBy("sample_id", "cell").agg(F.sum("p").alias("p"))
    best = j.groupBy("sample_id").agg(F.min_by(F.struct("lat", "lon"), F.struct(-F.col("p"), F.col("token"))).alias("_t"))
    return cells, best.select("sample_id", F.col("_t.lat").alias("top_lat"), F.col("_t.lon").alias("top_lon"))


def location_metrics(ranked: DataFrame, grid: SquareGrid, top: DataFrame | None = None, point_only: bool = False,
                     smooth: float = 1e-6) -> DataFrame:
    """Per sample acc@k, mrr@20, loc_nll and distance of the top-1 place. A point predictor has no
    ranking below the first place, so it gets acc@1 and distances only."""
    if top is None:
        lat, lon = grid.centroid(F.col("top"))
        rows = ranked.withColumns({"top_lat": lat, "top_lon": lon})
    else:
        rows = ranked.join(top, "sample_id")
    d = haversine_m(F.col("top_lat"), F.col("top_lon"), F.col("lat"), F.col("lon"))
    hit = lambda k: F.when(F.col("rank") <= k, 1.0).otherwise(0.0)
    out = {"acc@1": hit(1)}
    if not point_only:
        out.update({"acc@5": hit(5), "acc@10": hit(10), "acc@20": hit(20),
                    "mrr@20": F.when(F.col("rank") <= 20, 1.0 / F.col("rank")).otherwise(0.0),
                    "loc_nll": -F.log((1 - smooth) * F.col("p") + smooth / grid.n_cells)})
    rows = rows.withColumn("_d", d)
    out.update({"dist_err_m": F.col("_d"), "median_dist_err_m": F.col("_d"), "acc_1km": F.when(F.col("_d") <= 1000, 1.0).otherwise(0.0)})
    return melt(rows, ["sample_id"], out)


# ------------------------------------------------------------------ candidate sets
def candidate_cells(train: DataFrame, top_k: int) -> DataFrame:
    """The ``top_k`` most visited training target cells, numbered from 0 (ties by cell), with counts."""
    counts = train.groupBy(F.col("tgt.cell").alias("cell")).agg(F.count(F.lit(1)).alias("cnt"))
    top = counts.orderBy(F.desc("cnt"), "cell").limit(top_k)
    return top.select("cell", "cnt", (F.row_number().over(Window.orderBy(F.desc("cnt"), "cell")) - 1).alias("label"))


def candidate_metrics(probs: DataFrame, train: DataFrame, visits: DataFrame, candidates: DataFrame, grid: SquareGrid,
                      backoff: float = 1e-3) -> DataFrame:
    """Ranking among candidates only: a target outside is unreachable (rank infinite) and its
    likelihood is the popularity backoff. ``probs``: (sample_id, cell, p) over the candidates."""
    counts = train.groupBy(F.col("tgt.cell").alias("cell")).agg(F.count(F.lit(1)).alias("all_cnt"))
    total = max(counts.agg(F.sum("all_cnt")).first()[0] or 0, 1)
    ranked = rank_scores(probs, visits, grid.n_cells)
    rows = ranked.join(candidates.select("cell", F.lit(True).alias("inside")), "cell", "left") \
        .join(counts, "cell", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    p = F.when(F.col("inside"), (1 - backoff) * F.col("p")).otherwise(backoff * F.coalesce("all_cnt", F.lit(0)) / total)
    hit = lambda k: F.when(F.col("inside") & (F.col("rank") <= k), 1.0).otherwise(0.0)
    lat, lon = grid.centroid(F.col("top"))
    rows = rows.withColumn("_d", haversine_m(lat, lon, F.col("lat"), F.col("lon")))
    return melt(rows, ["sample_id"], {
        "acc@1": hit(1), "acc@5": hit(5), "acc@10": hit(10), "acc@20": hit(20),
        "mrr@20": F.when(F.col("inside") & (F.col("rank") <= 20), 1.0 / F.col("rank")).otherwise(0.0),
        "loc_nll": -F.log(F.least(F.greatest(p, F.lit(1e-9)), F.lit(1.0))),
        "probe_coverage": F.when(F.col("inside"), 1.0).otherwise(0.0),
        "dist_err_m": F.col("_d"), "median_dist_err_m": F.col("_d"), "acc_1km": F.when(F.col("_d") <= 1000, 1.0).otherwise(0.0)})


# ------------------------------------------------------------------ simple reference predictors
def recency_scores(visits: DataFrame, decay: float = 0.6, first_bonus: float = 0.5) -> DataFrame:
    """Recency-weighted frequency of the context cells, plus a bonus for the first one (home)."""
    c = visits.select("sample_id", F.posexplode("ctx.cell").alias("k", "cell"), F.size("ctx").alias("n"))
    score = F.pow(F.lit(decay), F.col("n") - 1 - F.col("k")) + F.when(F.col("k") == 0, first_bonus).otherwise(0.0)
    return c.groupBy("sample_id", "cell").agg(F.sum(score).alias("score"))


def next_to_last(visits: DataFrame) -> DataFrame:
    """Point prediction: the visit before the last one."""
    v = F.element_at("ctx", -2)
    return visits.select("sample_id", v["lat"].alias("top_lat"), v["lon"].alias("top_lon"))


def point_scores(points: DataFrame, grid: SquareGrid) -> DataFrame:
    return points.select("sample_id", grid.cell(F.col("top_lat"), F.col("top_lon")).alias("cell"), F.lit(1.0).alias("p"))
