"""Transport-mode classification over label fractions and seeds."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import union_all
from ..operators import classify, features, scores, splits


def labelled(windows: DataFrame, classes: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """One row per labelled window with its class index; classes come from training."""
    rows = windows.filter("pos = 0 and mode is not null").select("window_id", "mode")
    if classes is None:
        classes = [r[0] for r in rows.select("mode").distinct().orderBy("mode").collect()]     # one row per class
    return classify.label_index(rows, "mode", classes), classes


def mode_eval(train: DataFrame, test: DataFrame, fractions=(1.0,), seeds=(0,), models: dict[str, DataFrame] | None = None,
              n_boot: int = 0) -> DataFrame:
    """Records of class probabilities (window_id, probs) against a kinematic tree ensemble and the class
    priors, both fitted on the drawn fraction of training labels."""
    ltr, classes = labelled(train)
    lte, _ = labelled(test, classes)
    ftr = features.as_vector(features.kinematic_features(train), features.KINEMATIC).select("window_id", "vector")
    fte = features.as_vector(features.kinematic_features(test), features.KINEMATIC).select("window_id", "vector").join(lte, "window_id")
    parts, sets = [], []
    for fraction in fractions:
        for seed in (seeds if fraction < 1 else seeds[:1]):
            task = f"mode@{fraction:g}"
            sub = splits.stratified_fraction(ltr, "window_id", "mode", fraction, seed)
            prior = F.array(*[F.lit(p) for p in classify.majority(sub, "y", len(classes))])
            runs = {"baseline:handcrafted_trees": classify.tree_classifier(sub.join(ftr, "window_id"), fte, "window_id", seed=seed),
                    "baseline:majority": lte.select("window_id", "y", prior.alias("probs"))}
            runs.update({n: p.join(lte.select("window_id", "y"), "window_id") for n, p in (models or {}).items()})
            for name, rows in runs.items():
                keyed = rows.withColumns({"task": F.lit(task), "eval_seed": F.lit(seed), "model": F.lit(name)})
                parts.append(keyed.select("task", "eval_seed", "model", F.col("window_id").alias("sample_id"), "y", "probs"))
    both = union_all(parts)
    keys = ["task", "eval_seed", "model"]
    samples = classify.sample_metrics(both, [*keys, "sample_id"])
    records = scores.emit_records(samples, ["task", "eval_seed"], ["handcrafted_trees", "majority"], n_boot)
    wide = classify.set_metrics(both, keys)
    return records, scores.melt(wide, keys, {m: m for m in ("balanced_accuracy", "macro_f1", "ece")})
