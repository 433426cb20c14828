"""Linear probes on frozen embeddings."""
from __future__ import annotations

import logging
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.moments import outer_sums
from .classify import linear_probe
from .location import candidate_cells
from .splits import seeded_subset

log = logging.getLogger("wayspark.probes")


def _dot(vector: str, weights) -> F.Column:
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), w, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)


def ridge_weights(train: DataFrame, vector: str, alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """Ridge on log(max(y, 1e-3)) with training-standardised inputs and a free intercept, solved from
    the d x d normal equations that Spark sums up. Returned for the raw inputs."""
    rows = train.withColumn("_z", F.concat(F.col(vector).cast("array<double>"), F.array(F.log(F.greatest(F.col("y"), F.lit(1e-3))))))
    s = outer_sums(rows, "_z")
    n, d = s[-1, -1], len(s) - 2
    mu = s[-1, :d] / n
    sd = np.sqrt(np.maximum(np.diag(s)[:d] / n - mu ** 2, 0))
    sd = np.where(sd > 1e-12, sd, 1.0)
    ybar = s[-1, d] / n
    xx = (s[:d, :d] - n * np.outer(mu, mu)) / np.outer(sd, sd)
    xy = (s[:d, d] - n * mu * ybar) / sd
    # centred inputs leave the intercept uncoupled, so it stays unpenalised
    w = np.linalg.solve(xx + alpha * np.eye(d), xy) / sd
    return w, float(ybar - w @ mu)


LEAST_SPREAD = 1e-3


def continuous_probe(train: DataFrame, test: DataFrame, validation: DataFrame | None, vector: str = "vector", alpha: float = 1.0) -> DataFrame:
    """Log-normal forecast from ridge: ``point`` (its median) and ``mixture``. What the forecast is shifted by and how wide it is:

    | residuals of       | shift      | spread             |
    |--------------------|------------|--------------------|
    | validation, 2 rows | their mean | their deviation    |
    | validation, fewer  | 0          | 1                  |
    | training           | 0          | their deviation    |

    A spread that is missing, not finite or 0 is 1, and none is below ``LEAST_SPREAD``.
    """
    w, b = ridge_weights(train, vector, alpha)
    predict = _dot(vector, w) + F.lit(b)
    resid = F.log(F.greatest(F.col("y"), F.lit(1e-3))) - predict
    source = "training" if validation is None else "validation"
    mean, deviation, n = {"training": train, "validation": validation}[source].agg(F.avg(resid), F.stddev_pop(resid), F.count(F.lit(1))).first()
    shift, spread = {("training", True): (0.0, deviation), ("training", False): (0.0, deviation),
                     ("validation", True): (mean, deviation), ("validation", False): (0.0, 1.0)}[source, n > 1]
    if source == "training":
        log.warning("the probe's forecasts are as wide as its residuals on its own training rows, for want of others")
    usable = spread is not None and math.isfinite(spread) and spread > 0
    spread = max(float(spread), LEAST_SPREAD) if usable else 1.0
    centre = predict + F.lit(float(shift))
    one = lambda c, name: F.array(c).alias(name)
    mixture = F.struct(one(F.lit(1.0), "w"), one(centre, "mu"), one(F.lit(spread), "sd"), F.lit("log").alias("space"))
    return test.withColumns({"point": F.exp(centre), "mixture": mixture})


def location_probe(train: DataFrame, test: DataFrame, top_k: int, max_train: int = 100_000, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Linear softmax over the most visited training cells: sparse (sample_id, cell, p) and the
    candidates. ``train``/``test``: visits with an ``embedding``; ``max_train`` is the probe's own
    training sample size."""
    cand = candidate_cells(train, top_k)
    rows = train.select("sample_id", F.col("tgt.cell").alias("cell"), "embedding").join(cand.select("cell", "label"), "cell")
    fit = seeded_subset(rows, "sample_id", max_train, seed, "probe").withColumnRenamed("label", "y")
    probs = linear_probe(fit, test.select("sample_id", "embedding"), "sample_id", "embedding")
    out = probs.select("sample_id", F.posexplode("probs").alias("label", "p"))
    return out.join(cand.select("cell", "label"), "label").select("sample_id", "cell", "p"), cand
