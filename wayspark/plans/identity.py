"""User identification from frozen vectors, with the position-only control."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import union_all
from ..operators import classify, features, scores


def identity_eval(windows: DataFrame, vectors: dict[str, DataFrame], min_windows: int, max_users: int, n_boot: int = 0):
    """Linear probes on (window_id, vector) tables against the mean-location probe, its tree version and
    the priors. Returns (records, set-level values)."""
    cohort = classify.user_cohort(windows, min_windows, max_users).select("user_id", "y")
    k = cohort.count()
    if k < 2:
        raise ValueError("fewer than two users have enough windows in both splits")
    rows = windows.join(F.broadcast(cohort), "user_id")          # at most max_users rows
    place = features.as_vector(features.location_features(rows), features.PLACE).select("window_id", "vector")
    labels = rows.filter("pos = 0").select("window_id", "split", "y")
    part = lambda v, s: v.join(labels.filter(F.col("split") == s), "window_id").select("window_id", "y", "vector")
    prior = F.array(*[F.lit(p) for p in classify.majority(labels.filter("split = 'train'"), "y", k)])
    runs = {"baseline:mean_location": classify.linear_probe(part(place, "train"), part(place, "test"), "window_id"),
            "baseline:mean_location_trees": classify.tree_classifier(part(place, "train"), part(place, "test"), "window_id"),
            "baseline:majority": labels.filter("split = 'test'").select("window_id", "y", prior.alias("probs"))}
    runs.update({n: classify.linear_probe(part(v, "train"), part(v, "test"), "window_id") for n, v in vectors.items()})
    both = union_all([r.select(F.lit(n).alias("model"), F.col("window_id").alias("sample_id"), "y", "probs") for n, r in runs.items()])
    both = both.withColumn("task", F.lit(f"user_identification@{k}users"))
    samples = classify.identity_metrics(both, ["task", "model", "sample_id"], k)
    f1 = classify.set_metrics(both, ["task", "model"]).select("task", "model", F.col("macro_f1").alias("user_macro_f1"))
    return scores.emit_records(samples, ["task"], ["mean_location", "mean_location_trees", "majority"], n_boot), f1
