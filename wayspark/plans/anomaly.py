"""Anomaly detection on injected anomalies, scored without labels."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import union_all
from ..functions.geo import haversine_m
from ..operators import detection, features, inject, masks, recovery, scores
from ..session import cut_lineage

RUN = ["kind", "eval_seed"]


def _flat(injected: DataFrame) -> DataFrame:
    """Injected windows under one key per (kind, seed, window)."""
    return injected.withColumn("case", F.concat_ws("|", "kind", F.col("eval_seed").cast("string"), "window_id"))


def embedding_distance(train: DataFrame, flat: DataFrame, embed: Callable[[DataFrame], DataFrame], k: int = 10) -> DataFrame:
    """Mean distance of every injected window's embedding to the ``k`` nearest of normal training windows: (case, score). ``embed`` maps long windows to
    (window_id, vector); injected windows get names of their own, so that none is taken for the clean one it came from."""
    own = flat.drop("window_id").withColumnRenamed("case", "window_id")
    return detection.knn_distance(embed(train), embed(own).select("window_id", "vector"), "window_id", "vector", k).withColumnRenamed("window_id", "case")


def place_vectors(windows: DataFrame) -> DataFrame:
    return features.as_vector(features.location_features(windows), features.PLACE)


def reconstruction_error(injected: DataFrame, length: int, ratio: float = 0.3, mask_seed: int = 0) -> DataFrame:
    """Mean error of the linear fill at drawn positions of each (corrupted) window; the same masks for
    every kind. (kind, eval_seed, window_id, score)."""
    run = [("random", ratio, mask_seed, "anomaly")]
    rows = _flat(injected).select("case", "window_id", "kind", F.col("eval_seed").alias("_seed"), "pos", "t", "lat", "lon") \
        .withColumnRenamed("kind", "_kind")
    masked = masks.with_masks(rows.withColumnRenamed("window_id", "_w").withColumnRenamed("case", "window_id"), run, length)
    table = recovery.reconstructions(masked, ["window_id"])
    d = haversine_m(F.col("li_lat"), F.col("li_lon"), F.col("lat"), F.col("lon"))
    return table.filter("hidden").groupBy(F.col("_kind").alias("kind"), F.col("_seed").alias("eval_seed"), F.col("_w").alias("window_id")) \
        .agg(F.avg(d).alias("score"))


def anomaly_scores(train: DataFrame, test: DataFrame, length: int, kinds=inject.KINDS, rate: float = 0.1, seeds=(0,), k: int = 10,
                   embeddings: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """(kind, eval_seed, model, protocol, window_id, y, score) of the two baselines, of linear-fill reconstruction and of the distance to
    training embeddings for each of ``embeddings`` (position statistics if none are given)."""
    flat = cut_lineage(_flat(inject.inject(test, length, kinds, rate, seeds)))
    labels = flat.filter("pos = 0").select("kind", "eval_seed", "window_id", "case", F.col("is_bad").alias("y"))
    named = lambda rows, model, protocol, key="case": rows.join(labels, key).withColumns({"model": F.lit(model), "protocol": F.lit(protocol)})
    ftr, fte = features.kinematic_features(train), features.kinematic_features(flat, "case")
    parts = [named(features.max_step(flat, "case"), "baseline:max_step", "baseline"),
             named(detection.kinematic_knn(ftr, fte, "case", features.KINEMATIC, k), "baseline:kinematic_knn", "baseline"),
             named(reconstruction_error(flat.drop("case"), length), "linear_fill", "reconstruction", [*RUN, "window_id"])]
    parts += [named(embedding_distance(train, flat, embed, k), name, "embedding_knn") for name, embed in (embeddings or {"place": place_vectors}).items()]
    return union_all([r.select(*RUN, "model", "protocol", "window_id", "y", "score") for r in parts])


def anomaly_eval(scored: DataFrame, min_windows: int = 20) -> DataFrame:
    """Detection metrics per kind, seed and model with skill against the kinematic baseline."""
    scored = cut_lineage(scored)
    sizes = scored.groupBy(*RUN, "model", "protocol").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_windows)
    m = detection.detection_metrics(scored, [*RUN, "model", "protocol"]).join(sizes, [*RUN, "model", "protocol"])
    long = scores.melt(m, [*RUN, "model", "protocol", "n"], {"roc_auc": "roc_auc", "pr_auc": "pr_auc", "precision@k": "precision_at_k"})
    base = scores.preferred_baseline(long, RUN, ["kinematic_knn", "max_step"])
    out = long.join(base, [*RUN, "metric"], "left")
    is_base = F.col("model").startswith("baseline:")
    out = out.withColumns({c: F.when(~is_base, F.col(c)) for c in ("baseline", "baseline_value")})
    return out.withColumn("skill", scores.skill_score(F.col("value"), F.col("baseline_value"), F.lit("bounded")))
