"""Travel time and stay duration: forecasts as points, mixtures or samples, in minutes."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import time_of_day
from ..functions.normal import mixture
from ..functions.ordered import exact_percentiles, range_chunks, running
from .scores import melt

TRAVEL_MAX_MIN = 240.0


def target_minutes(visits: DataFrame, target: str, travel_max_min: float | None = TRAVEL_MAX_MIN) -> DataFrame:
    """Valid samples with ``y`` in minutes: finite, positive, and travel not above the limit."""
    column = {"travel_time": "tgt.travel_s", "duration": "tgt.duration_s"}[target]
    y = F.col(column) / 60.0
    ok = y.isNotNull() & ~F.isnan(y) & (y > 0)
    if target == "travel_time" and travel_max_min is not None:
        ok = ok & (y <= travel_max_min)
    return visits.withColumn("y", y).filter(ok)


def support_max(train: DataFrame) -> float:
    """99th percentile of the training target."""
    return exact_percentiles(train, [], "y", {"p": 0.99}).first()[0]


def own_context_mixture(visits: DataFrame, target: str) -> DataFrame:
    """Log-normal of the sample's own context: mean and spread of log seconds."""
    if target == "duration":
        logs = F.transform("ctx", lambda v: F.log(F.greatest(v["t_leave"] - v["t_arrive"], F.lit(60.0))))
    else:
        pairs = F.arrays_zip(F.expr("slice(ctx, 2, size(ctx) - 1)").alias("b"), F.expr("slice(ctx, 1, size(ctx) - 1)").alias("a"))
        logs = F.transform(pairs, lambda p: F.log(F.greatest(p["b"]["t_arrive"] - p["a"]["t_leave"], F.lit(30.0))))
    rows = visits.withColumn("_l", logs)
    mean = F.aggregate("_l", F.lit(0.0), lambda a, x: a + x) / F.size("_l")
    rows = rows.withColumn("_m", mean)
    sd = F.sqrt(F.aggregate("_l", F.lit(0.0), lambda a, x: a + (x - F.col("_m")) * (x - F.col("_m"))) / F.size("_l")) + 0.3
    mix = F.struct(F.array(F.lit(1.0)).alias("w"), F.array("_m").alias("mu"), F.array(sd).alias("sd"), F.lit("log").alias("space"))
    return rows.withColumn("mixture", mix).drop("_l", "_m")


def point_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """From ``y`` and ``point``: absolute, squared and relative error; CRPS of a point is its error."""
    e = F.abs(F.col("point") - F.col("y"))
    return melt(rows, keys, {"mae_min": e, "rmse_min": e * e, "mape": e / F.greatest(F.col("y"), F.lit(1e-9)), "crps_min": e})


def pseudo_nll(rows: DataFrame, keys: list[str], sigma: float) -> DataFrame:
    r = (F.col("y") - F.col("point")) / sigma
    return melt(rows, keys, {"pseudo_nll": 0.5 * math.log(2 * math.pi) + math.log(sigma) + 0.5 * r * r})


def residual_sigma(validation: DataFrame) -> float:
    """Spread of the validation residuals of a point model; 1 where undefined."""
    s = validation.agg(F.stddev_pop(F.col("y") - F.col("point"))).first()[0]
    return s if s is not None and math.isfinite(s) and s > 0 else 1.0


def mixture_scores(rows: DataFrame) -> DataFrame:
    """Adds nll, crps, pit and the mixture median (``point`` if the forecast has none)."""
    mix, y = F.col("mixture"), F.col("y")
    out = rows.withColumns({"nll": mixture("nll", mix, y), "crps_min": mixture("crps", mix, y), "pit": mixture("cdf", mix, y)})
    own = F.col("point") if "point" in rows.columns else F.lit(None).cast("double")
    return out.withColumn("point", F.coalesce(own, mixture("median", mix)))


def mixture_metrics(rows: DataFrame, keys: list[str], upper: float | None = None) -> DataFrame:
    s = mixture_scores(rows)
    e = F.abs(F.col("point") - F.col("y"))
    out = {"mae_min": e, "rmse_min": e * e, "mape": e / F.greatest(F.col("y"), F.lit(1e-9)), "crps_min": F.col("crps_min"),
           "nll": F.col("nll"), "coverage80": coverage80(F.col("pit"))}
    if upper is not None:
        s, within = _mixture_within(s, upper)
        out.update(within)
    return melt(s, keys, out)


def coverage80(pit: Column) -> Column:
    return F.when((pit >= 0.1) & (pit <= 0.9), 1.0).otherwise(0.0)


def _mixture_within(rows: DataFrame, upper: float, within=(5, 10, 20)):
    mix, y = F.col("mixture"), F.least(F.greatest(F.col("y"), F.lit(0.0)), F.lit(upper))
    s = rows.withColumn("_den", mixture("cdf", mix, F.lit(upper)) - mixture("cdf", mix, F.lit(0.0)))
    out = {}
    for t in within:
        s = s.withColumn(f"_num{t}", mixture("cdf", mix, F.least(y + t, F.lit(upper))) - mixture("cdf", mix, F.greatest(y - t, F.lit(0.0))))
        share = F.when(F.col("_den") > 1e-12, F.col(f"_num{t}") / F.greatest(F.col("_den"), F.lit(1e-12))).otherwise(0.0)
        out[f"p_within_{t}min"] = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    return s, out


def point_within(rows: DataFrame, keys: list[str], upper: float, within=(5, 10, 20)) -> DataFrame:
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(upper))
    d = F.abs(clip("point") - clip("y"))
    return melt(rows, keys, {f"p_within_{t}min": F.when(d <= t, 1.0).otherwise(0.0) for t in within})


def sample_metrics(rows: DataFrame, keys: list[str], upper: float | None = None) -> DataFrame:
    """Ensemble forecasts (``samples`` array, sorted here): CRPS by the sorted-sample estimator."""
    x, n = F.col("_x"), F.size("_x")
    s = rows.withColumn("_x", F.array_sort("samples"))
    t1 = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.abs(v - F.col("y"))) / n
    t2 = F.aggregate(F.transform(x, lambda v, i: v * (2 * (i + 1) - n - 1)), F.lit(0.0), lambda a, v: a + v) / (n * n)
    mid = (F.element_at(x, F.floor((n + 1) / 2).cast("int")) + F.element_at(x, (F.floor(n / 2) + 1).cast("int"))) / 2
    pit = F.size(F.filter(x, lambda v: v <= F.col("y"))) / n
    s = s.withColumns({"crps_min": t1 - t2, "_p": mid, "pit": pit})
    e = F.abs(F.col("_p") - F.col("y"))
    out = {"crps_min": F.col("crps_min"), "mae_min": e, "rmse_min": e * e, "coverage80": coverage80(F.col("pit"))}
    if upper is not None:
        y = F.least(F.greatest(F.col("y"), F.lit(0.0)), F.lit(upper))
        s = s.withColumn("_y", y)
        inside = F.filter(x, lambda v: (v >= 0) & (v <= upper))
        for t in (5, 10, 20):
            near = F.filter(x, lambda v: (v >= F.greatest(F.col("_y") - t, F.lit(0.0))) & (v <= F.least(F.col("_y") + t, F.lit(upper))))
            out[f"p_within_{t}min"] = F.size(near) / F.greatest(F.size(inside), F.lit(1))
    return melt(s, keys, out)


def pit_ks(rows: DataFrame, keys: list[str], pit: str = "pit") -> DataFrame:
    """Largest gap between the distribution of PIT values and the uniform one, per group."""
    groups = keys or ["_all"]
    base = rows if keys else rows.withColumn("_all", F.lit(0))
    counts = base.groupBy(*groups, pit).agg(F.count(F.lit(1)).alias("_n"))
    chunks = range_chunks(counts, [*groups, pit])
    sizes = chunks.groupBy(*groups).agg(F.sum("_n").alias("_size"))
    r = running(chunks, groups, [pit], {"_upto": F.col("_n")}).join(sizes, groups)
    gap = F.greatest(F.col("_upto") / F.col("_size") - F.col(pit), F.col(pit) - (F.col("_upto") - F.col("_n")) / F.col("_size"))
    return r.groupBy(*groups).agg(F.max(gap).alias("pit_ks")).select(*keys, "pit_ks")


def revealed_features(visits: DataFrame, reveal: tuple[str, ...]) -> DataFrame:
    """Teacher-forced target fields as extra inputs: location and/or arrival time of day."""
    parts = []
    if "location" in reveal:
        parts += [F.col("tgt.lat"), F.col("tgt.lon")]
    if "arrival" in reveal:
        parts += list(time_of_day(F.col("tgt.t_arrive")))
    return visits.withColumn("revealed", F.array(*[p.cast("double") for p in parts]))


def train_marginal(train: DataFrame, k: int = 3, seed: int = 0) -> tuple[float, dict]:
    """Median and a Gaussian mixture of log minutes of the training target."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler
    median = exact_percentiles(train, [], "y", {"p": 0.5}).first()[0]
    logs = VectorAssembler(inputCols=["ly"], outputCol="features").transform(train.select(F.log("y").alias("ly")))
    fit = GaussianMixture(k=k, seed=seed, maxIter=100).fit(logs)
    parts = [(g.mean[0], math.sqrt(g.cov.toArray()[0][0])) for g in fit.gaussians]
    return median, {"w": [float(w) for w in fit.weights], "mu": [float(m) for m, _ in parts], "sd": [float(s) for _, s in parts]}


def constant_mixture(rows: DataFrame, mix: dict, space: str = "log") -> DataFrame:
    arr = lambda v: F.array(*[F.lit(float(x)) for x in v])
    return rows.withColumn("mixture", F.struct(arr(mix["w"]).alias("w"), arr(mix["mu"]).alias("mu"), arr(mix["sd"]).alias("sd"), F.lit(space).alias("space")))
