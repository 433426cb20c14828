"""Metric registry: the one place that fixes direction, unit, range, skill formula and aggregate."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Name, family, higher is better, unit, skill, low, high, plausible maximum, aggregate.
# None is unbounded; skill is ratio, bounded, difference, floor or none.
METRICS = (
    ("ade_m", "recovery", False, "m", "ratio", 0, None, 20000, "mean"),
    ("median_ade_m", "recovery", False, "m", "ratio", 0, None, 20000, "median"),
    ("p90_ade_m", "recovery", False, "m", "ratio", 0, None, 50000, "p90"),
    ("rmse_m", "recovery", False, "m", "ratio", 0, None, 50000, "rmse"),
    ("fde_m", "recovery", False, "m", "ratio", 0, None, 20000, "mean"),
    ("dtw_m", "recovery", False, "m", "ratio", 0, None, 20000, "mean"),
    ("acc_100m", "recovery", True, "fraction", "bounded", 0, 1, None, "mean"),
    ("acc_500m", "recovery", True, "fraction", "bounded", 0, 1, None, "mean"),
    ("grid_acc", "recovery", True, "fraction", "bounded", 0, 1, None, "mean"),
    ("acc@1", "location", True, "fraction", "bounded", 0, 1, None, "mean"),
    ("acc@5", "location", True, "fraction", "bounded", 0, 1, None, "mean"),
    ("acc@10", "location", True, "fraction", "bounded", 0, 1, None, "mean"),
    ("acc@20", "location", True, "fraction", "bounded", 0, 1, None, "mean"),
    ("mrr@20", "location", True, "fraction", "bounded", 0, 1, None, "mean"),
    ("loc_nll", "location", False, "nats", "difference", 0, None, None, "mean"),
    ("dist_err_m", "location", False, "m", "ratio", 0, None, 50000, "mean"),
    ("median_dist_err_m", "location", False, "m", "ratio", 0, None, 50000, "median"),
    ("acc_1km", "location", True, "fraction", "bounded", 0, 1, None, "mean"),
    ("probe_coverage", "location", True, "fraction", "none", 0, 1, None, "mean"),
    ("mae_min", "continuous", False, "min", "ratio", 0, None, 1440, "mean"),
    ("rmse_min", "continuous", False, "min", "ratio", 0, None, 1440, "rmse"),
    ("crps_min", "continuous", False, "min", "ratio", 0, None, 1440, "mean"),
    ("nll", "continuous", False, "nats", "difference", None, None, None, "mean"),
    ("pseudo_nll", "continuous", False, "nats", "difference", None, None, None, "mean"),
    ("mape", "continuous", False, "fraction", "ratio", 0, None, 10, "mean"),
    ("p_within_5min", "continuous", True, "fraction", "bounded", 0, 1, None, "mean"),
    ("p_within_10min", "continuous", True, "fraction", "bounded", 0, 1, None, "mean"),
    ("p_within_20min", "continuous", True, "fraction", "bounded", 0, 1, None, "mean"),
    ("coverage80", "continuous", True, "fraction", "none", 0, 1, None, "mean"),
    ("pit_ks", "continuous", False, "stat", "none", 0, 1, None, "mean"),
    ("accuracy", "classification", True, "fraction", "bounded", 0, 1, None, "mean"),
    ("balanced_accuracy", "classification", True, "fraction", "bounded", 0, 1, None, "mean"),
    ("macro_f1", "classification", True, "fraction", "bounded", 0, 1, None, "mean"),
    ("cls_nll", "classification", False, "nats", "difference", 0, None, None, "mean"),
    ("ece", "classification", False, "fraction", "ratio", 0, 1, None, "mean"),
    ("jsd", "generation", False, "bits", "floor", 0, 1, None, "mean"),
    ("w1", "generation", False, "native", "floor", 0, None, None, "mean"),
    ("copy_rate", "generation", False, "fraction", "none", 0, 1, None, "mean"),
    ("nn_train_dist_m", "generation", True, "m", "none", 0, None, None, "median"),
    ("spearman_paired", "generation", True, "rho", "none", -1, 1, None, "mean"),
    ("user_acc@1", "identity", True, "fraction", "bounded", 0, 1, None, "mean"),
    ("user_acc@5", "identity", True, "fraction", "bounded", 0, 1, None, "mean"),
    ("user_mrr@20", "identity", True, "fraction", "bounded", 0, 1, None, "mean"),
    ("user_macro_f1", "identity", True, "fraction", "bounded", 0, 1, None, "mean"),
    ("user_nll", "identity", False, "nats", "difference", 0, None, None, "mean"),
    ("roc_auc", "anomaly", True, "auc", "bounded", 0, 1, None, "mean"),
    ("pr_auc", "anomaly", True, "auc", "bounded", 0, 1, None, "mean"),
    ("precision@k", "anomaly", True, "fraction", "bounded", 0, 1, None, "mean"),
    ("mean_rank", "retrieval", False, "rank", "ratio", 1, None, None, "mean"),
    ("mrr", "retrieval", True, "fraction", "bounded", 0, 1, None, "mean"),
    ("hr@1", "retrieval", True, "fraction", "bounded", 0, 1, None, "mean"),
    ("hr@5", "retrieval", True, "fraction", "bounded", 0, 1, None, "mean"),
    ("hr@10", "retrieval", True, "fraction", "bounded", 0, 1, None, "mean"),
    ("cr@1", "retrieval", True, "fraction", "bounded", 0, 1, None, "mean"),
    ("cr@5", "retrieval", True, "fraction", "bounded", 0, 1, None, "mean"),
    ("n_parameters", "efficiency", False, "count", "none", 0, None, None, "mean"),
    ("latency_ms_per_sample", "efficiency", False, "ms", "none", 0, None, None, "mean"),
)

# Metrics that enter the cross-family summary.
HEADLINE = ("ade_m", "fde_m", "dtw_m", "acc_100m", "acc@1", "acc@5", "dist_err_m", "crps_min", "mae_min", "macro_f1",
            "balanced_accuracy", "jsd", "user_acc@1", "user_macro_f1", "roc_auc", "pr_auc", "mrr", "hr@1", "cr@1")


def metric_rows() -> list[tuple]:
    number = lambda v: None if v is None else float(v)
    return [(*row[:5], *map(number, row[5:8]), row[8]) for row in METRICS]


def metric_registry(spark: SparkSession) -> DataFrame:
    """Dimension table of all metrics (fixed size, safe to broadcast)."""
    return spark.createDataFrame(metric_rows(), "base string, family string, higher_is_better boolean, unit string, "
                                 "skill_kind string, low double, high double, plausible_max double, aggregate string")


def with_spec(df: DataFrame, metric: str = "metric") -> DataFrame:
    """Joins the registry; a qualifier after ':' is ignored."""
    spec = F.broadcast(metric_registry(df.sparkSession))
    return df.withColumn("base", F.split(F.col(metric), ":")[0]).join(spec, "base").drop("base")
