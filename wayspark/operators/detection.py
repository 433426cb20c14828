"""Anomaly scores and threshold-free detection metrics."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import best_rows, matrix
from ..functions.moments import mean_and_cov
from ..functions.ordered import range_chunks, running
from ..functions.pivots import PivotIndex, euclidean
from ..session import cut_lineage
from .scores import finite


def finite_last(scores: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Scores that are missing or not finite rank as the most normal, below every finite one."""
    groups = keys or ["_all"]
    base = scores if keys else scores.withColumn("_all", F.lit(0))
    low = base.filter(finite(F.col(score))).groupBy(*groups).agg((F.min(score) - 1.0).alias("_floor"))
    out = base.join(low, groups, "left")
    return out.withColumn(score, F.when(finite(F.col(score)), F.col(score)).otherwise(F.coalesce("_floor", F.lit(0.0)))) \
        .drop("_floor", *([] if keys else ["_all"]))


def _tie_groups(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Per distinct score: size, positives, and both totals from the highest score down."""
    g = rows.groupBy(*groups, "score").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("bigint")).alias("pos"))
    g = range_chunks(g.withColumn("_down", -F.col("score")), [*groups, "_down"])
    sizes = g.groupBy(*groups).agg(F.sum("n").alias("n_all"), F.sum("pos").alias("n_pos"))
    return running(g, groups, ["_down"], {"cum_n": F.col("n"), "cum_tp": F.col("pos")}).join(sizes, groups)


def detection_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """roc_auc (ties count half), pr_auc (steps at distinct scores) and precision@k (k = positives; a
    tie group contributes its own rate). ``rows``: (keys, y boolean, score)."""
    groups = keys or ["_all"]
    base = finite_last(rows, keys) if keys else finite_last(rows, keys).withColumn("_all", F.lit(0))
    t = _tie_groups(base, groups)
    p, n, tp, before = F.col("n_pos"), F.col("cum_n"), F.col("cum_tp"), F.col("cum_n") - F.col("n")
    negatives = F.col("n_all") - p
    # a tie group holds ranks n_all - cum_n + 1 .. n_all - before counted from the lowest score
    mean_rank = F.col("n_all") - before - (F.col("n") - 1) / 2.0
    auc = (F.sum(F.col("pos") * mean_rank) - F.max(p) * (F.max(p) + 1) / 2.0) / (F.max(p) * F.max(negatives))
    steps = F.sum(F.when(p > 0, F.col("pos") / p * (tp / n)))
    holds = (n >= p) & (before < p)
    at_k = F.max(F.when(holds, (tp - F.col("pos") + F.col("pos") * (p - before) / F.col("n")) / p))
    out = t.groupBy(*groups).agg(F.when((F.max(p) > 0) & (F.max(negatives) > 0), auc).alias("roc_auc"),
                                 F.when(F.max(p) > 0, steps).alias("pr_auc"), at_k.alias("precision_at_k"))
    return out.select(*keys, "roc_auc", "pr_auc", "precision_at_k")


def knn_distance(train: DataFrame, test: DataFrame, key: str, vector: str = "vector", k: int = 10,
                 standardise: bool = True) -> DataFrame:
    """Mean Euclidean distance to the ``k`` nearest training vectors, standardised by training: (key, score), keys unique.

    The k-th distance within the cells around a test row bounds its true one; only cells that may hold nearer rows are
    searched after that (``functions/pivots.py``). Exact for any sizes.
    """
    mu, cov, n = mean_and_cov(train, vector)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    mu, sd = (mu, np.where(sd > 1e-12, sd, 1.0)) if standardise else (np.zeros_like(mu), np.ones_like(sd))
    k = max(1, min(k, n))

    def nearest(tests, trains):
        z, x = (matrix(t.column("v"), t.num_rows) for t in (tests, trains))
        best = np.full((len(z), 0), np.inf)
        step = max(1, 4_000_000 // len(z))
        for lo in range(0, len(x), step):
            part = x[lo:lo + step]
            d2 = (z ** 2).sum(1)[:, None] + (part ** 2).sum(1)[None, :] - 2.0 * z @ part.T
            best = np.concatenate([best, np.maximum(d2, 0.0)], axis=1)
            if best.shape[1] > k:
                best = np.partition(best, k - 1, axis=1)[:, :k]
        return {key: tests.column(key).combine_chunks().take(np.repeat(np.arange(len(z)), best.shape[1])), "d2": best.ravel()}

    def scaled(df, *columns):
        kinds = ", ".join([*[f"{c} {df.schema[c].dataType.simpleString()}" for c in columns], "v array<double>"])

        def run(batches):
            for batch in batches:
                z = (matrix(batch.column(len(columns)), batch.num_rows) - mu) / sd if batch.num_rows else np.zeros((0, len(mu)))
                v = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * len(mu), pa.int32()), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], v], names=[*columns, "v"])
        return df.select(*columns, F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, kinds)

    index = PivotIndex(scaled(train), "v", euclidean, 8 * len(mu))
    size, schema = 8 * (len(mu) + k), f"{key} {test.schema[key].dataType.simpleString()}, d2 double"
    home = cut_lineage(index.home(scaled(test, key), k))
    first = cut_lineage(best_rows(index.compare(home, nearest, schema, size), key, ["d2"], k, "_place").drop("_place"))
    bound = first.groupBy(key).agg(F.sqrt(F.max("d2")).alias("_bound"))
    rest = cut_lineage(index.around(home.withColumnRenamed("_cells", "_home").join(bound, key), "_bound", skip="_home").drop("_home", "_bound"))
    found = first.unionByName(index.compare(rest, nearest, schema, size))
    return best_rows(found, key, ["d2"], k, "_place").groupBy(key).agg((F.sum(F.sqrt("d2")) / k).alias("score"))


def mahalanobis_distance(train: DataFrame, test: DataFrame, key: str, vector: str = "vector", shrinkage: float = 0.1) -> DataFrame:
    """Distance to the training Gaussian with shrunk covariance; the d x d inverse is the only thing
    computed on the driver."""
    mu, cov, _ = mean_and_cov(train, vector, ddof=1)
    d = len(mu)
    prec = np.linalg.pinv((1 - shrinkage) * cov + shrinkage * np.trace(cov) / d * np.eye(d))

    def score(batches):
        import pyarrow as pa
        for batch in batches:
            x = matrix(batch.column(1), batch.num_rows) - mu if batch.num_rows else np.zeros((0, d))
            s = np.sqrt(np.maximum(((x @ prec) * x).sum(1), 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=[key, "score"])

    kind = test.schema[key].dataType.simpleString()
    return test.select(key, F.col(vector).cast("array<double>")).mapInArrow(score, f"{key} {kind}, score double")


def kinematic_knn(train_features: DataFrame, test_features: DataFrame, key: str, names, k: int = 10) -> DataFrame:
    """kNN distance in kinematic feature space: training rows with a non-finite value are left out,
    test values are replaced by 0."""
    ok = F.lit(True)
    for n in names:
        ok = ok & finite(F.col(n).cast("double"))
    train = train_features.filter(ok).withColumn("vector", F.array(*[F.col(n).cast("double") for n in names]))
    clean = lambda n: F.when(finite(F.col(n).cast("double")), F.col(n).cast("double")).otherwise(0.0)
    test = test_features.withColumn("vector", F.array(*[clean(n) for n in names]))
    return knn_distance(cut_lineage(train.select("vector")), test, key, "vector", k)
