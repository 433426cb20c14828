"""Classification metrics, fitted classifiers and the user-identification cohort."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scores import melt

EPS = 1e-9


def _total(c) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def shares(c) -> Column:
    """Every entry over the total; lambdas bind the array and its total, so that neither is computed anew for an entry."""
    over_total = lambda a: F.transform(F.array(_total(a)), lambda total: F.transform(a, lambda x: x / total))[0]
    return F.transform(F.array(c), over_total)[0]


def normalise_probs(rows: DataFrame, column: str = "probs") -> DataFrame:
    """Class scores as probabilities: kept when every row already sums to one, else softmax."""
    ok = rows.agg(F.bool_and((F.array_min(column) >= 0) & (F.abs(_total(F.col(column)) - 1) <= 1e-3))).first()[0]
    if ok:
        return rows.withColumn(column, shares(F.col(column)))
    e = F.transform(F.array(F.array_max(column)), lambda top: F.transform(column, lambda x: F.exp(x - top)))[0]
    return rows.withColumn(column, shares(e))


def predictions(rows: DataFrame) -> DataFrame:
    """Adds ``pred`` (first best class) and ``p_true`` from ``probs`` and the 0-based label ``y``."""
    return rows.withColumns({"pred": (F.array_position("probs", F.array_max("probs")) - 1).cast("int"),
                             "p_true": F.element_at("probs", (F.col("y") + 1).cast("int"))})


def sample_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    r = predictions(rows)
    return melt(r, keys, {"accuracy": F.when(F.col("pred") == F.col("y"), 1.0).otherwise(0.0),
                          "cls_nll": -F.log(F.least(F.greatest(F.col("p_true"), F.lit(EPS)), F.lit(1.0)))})


def set_metrics(rows: DataFrame, keys: list[str], n_bins: int = 10) -> DataFrame:
    """balanced_accuracy, macro_f1 (absent classes skipped) and ece from a confusion table."""
    groups = keys or ["_all"]
    r = predictions(rows if keys else rows.withColumn("_all", F.lit(0)))
    conf = r.groupBy(*groups, "y", "pred").agg(F.count(F.lit(1)).alias("n"))
    truth = conf.groupBy(*groups, "y").agg(F.sum("n").alias("n_true"), F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    said = conf.groupBy(*groups, F.col("pred").alias("y")).agg(F.sum("n").alias("n_pred"))
    per = truth.join(said, [*groups, "y"], "left")
    f1 = F.when(F.col("tp") == 0, 0.0).otherwise(2 * F.col("tp") / (F.col("n_true") + F.coalesce("n_pred", F.lit(0))))
    scores = per.groupBy(*groups).agg(F.avg(F.col("tp") / F.col("n_true")).alias("balanced_accuracy"), F.avg(f1).alias("macro_f1"))
    conf_bin = F.least(F.floor(F.array_max("probs") * n_bins), F.lit(n_bins - 1))
    bins = r.groupBy(*groups, conf_bin.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.array_max("probs")).alias("c"),
                                                       F.avg(F.when(F.col("pred") == F.col("y"), 1.0).otherwise(0.0)).alias("a"))
    ece = bins.groupBy(*groups).agg((F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))) / F.sum("n")).alias("ece"))
    return scores.join(ece, groups).select(*keys, "balanced_accuracy", "macro_f1", "ece")


def majority(train: DataFrame, label: str = "y", n_classes: int | None = None) -> list[float]:
    """Class priors of training, with a small constant for absent classes."""
    counts = {r[0]: r[1] for r in train.groupBy(label).agg(F.count(F.lit(1))).collect()}      # one row per class
    n_classes = n_classes or max(counts) + 1
    raw = [counts.get(c, 0) + 1e-3 for c in range(n_classes)]
    return [v / sum(raw) for v in raw]


def label_index(df: DataFrame, label: str, classes: list[str]) -> DataFrame:
    known = F.array(*[F.lit(c) for c in classes])
    return df.filter(F.col(label).isin(classes)).withColumn("y", (F.array_position(known, F.col(label)) - 1).cast("int"))


def _vectors(df: DataFrame, column: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    return df.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))


def _probabilities(model, test: DataFrame, key: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    return model.transform(test).select(key, *[c for c in ("y",) if c in test.columns], vector_to_array("probability").alias("probs"))


def linear_probe(train: DataFrame, test: DataFrame, key: str, vector: str = "vector", c: float = 1.0) -> DataFrame:
    """Standardised multinomial logistic regression on frozen vectors: (key, y, probs)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    tr = _vectors(train, vector)
    n = tr.count()
    steps = [StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
             LogisticRegression(featuresCol="scaled", labelCol="y", family="multinomial", regParam=1.0 / (c * max(n, 1)),
                                standardization=False, maxIter=200)]
    return _probabilities(Pipeline(stages=steps).fit(tr), _vectors(test, vector), key)


def tree_classifier(train: DataFrame, test: DataFrame, key: str, vector: str = "vector", seed: int = 0, trees: int = 60) -> DataFrame:
    """Multi-class tree ensemble on features (Spark's boosted trees are binary)."""
    from pyspark.ml.classification import RandomForestClassifier
    model = RandomForestClassifier(labelCol="y", numTrees=trees, maxDepth=8, seed=seed).fit(_vectors(train, vector))
    return _probabilities(model, _vectors(test, vector), key)


def user_cohort(windows: DataFrame, min_windows: int, max_users: int) -> DataFrame:
    """Users with enough windows in train and test, the largest by the smaller of both counts
    (ties by id), with a label in id order."""
    n = windows.filter("pos = 0").groupBy("user_id").agg(F.count(F.when(F.col("split") == "train", 1)).alias("n_train"),
                                                         F.count(F.when(F.col("split") == "test", 1)).alias("n_test"))
    top = n.filter((F.col("n_train") >= min_windows) & (F.col("n_test") >= min_windows)) \
        .orderBy(F.desc(F.least("n_train", "n_test")), "user_id").limit(max_users)
    return top.withColumn("y", F.row_number().over(Window.orderBy("user_id")) - 1)


def identity_metrics(rows: DataFrame, keys: list[str], n_users: int, smooth: float = 1e-6) -> DataFrame:
    """user_acc@1 / @5, user_mrr@20 and user_nll; top-k only where it can fail."""
    r = predictions(rows)
    rank = F.size(F.filter("probs", lambda p: p >= F.col("p_true")))
    hit = lambda k: F.when(F.col("_r") <= k, 1.0).otherwise(0.0)
    out = {"user_acc@1": hit(1), "user_nll": -F.log((1 - smooth) * F.col("p_true") + smooth / n_users)}
    if n_users > 5:
        out["user_acc@5"] = hit(5)
    if n_users > 20:
        out["user_mrr@20"] = F.when(F.col("_r") <= 20, 1.0 / F.col("_r")).otherwise(0.0)
    return melt(r.withColumn("_r", rank), keys, out)
