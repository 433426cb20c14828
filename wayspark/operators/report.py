"""Leaderboards and summaries over result records."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.registry import HEADLINE, with_spec

KEYS = ["family", "task", "metric", "protocol", "model"]

# Skill below which a model counts as no better than its baseline.
FIT_MIN_SKILL = 0.02


def leaderboard(records: DataFrame, family: str | None = None) -> DataFrame:
    """Mean over seeds and tags with the sample deviation; first baseline, largest n."""
    rows = records if family is None else records.filter(F.col("family") == family)
    mean = lambda c: F.avg(c).alias(c)
    return rows.groupBy(*KEYS).agg(
        F.avg("value").alias("value"), F.stddev_samp("value").alias("std"), mean("ci_low"), mean("ci_high"), mean("skill"),
        mean("skill_ci_low"), mean("skill_ci_high"), F.count(F.lit(1)).alias("n_runs"), F.max("n").alias("n"),
        F.min_by("baseline", F.struct("eval_seed", "run_tag")).alias("baseline"), F.first("higher_is_better", True).alias("higher_is_better"),
        F.first("unit", True).alias("unit"), F.coalesce(F.max("paper_match"), F.lit("")).alias("paper_match"))


def family_long(records: DataFrame, clip: float = 1.0) -> DataFrame:
    """(model, family, skill): median over headline metrics of the clipped mean skill per metric."""
    d = with_spec(records.filter(~F.col("model").startswith("baseline:") & F.col("skill").isNotNull())
                  .select("model", "task", "metric", "skill"))
    d = d.filter(F.col("skill_kind").isin("ratio", "bounded", "floor") & F.split("metric", ":")[0].isin(*HEADLINE))
    s = F.least(F.greatest(F.col("skill"), F.lit(-clip)), F.lit(clip))
    per = d.groupBy("model", "family", "task", "metric").agg(F.avg(s).alias("skill"))
    return per.groupBy("model", "family").agg(F.percentile("skill", 0.5).alias("skill"))     # tasks x metrics: few


def family_summary(records: DataFrame, clip: float = 1.0) -> DataFrame:
    return family_long(records, clip).groupBy("model").pivot("family").agg(F.first("skill"))


def pareto_front(records: DataFrame) -> DataFrame:
    """Models not dominated on mean skill (up), parameters and latency (down); missing sizes are not
    compared. One row per model, so the self anti-join is small."""
    q = family_long(records).groupBy("model").agg(F.avg("skill").alias("mean_skill"))
    size = lambda metric, name: records.filter(F.col("metric") == metric).groupBy("model").agg(F.avg("value").alias(name))
    q = q.join(size("n_parameters", "n_parameters"), "model", "left").join(size("latency_ms_per_sample", "latency_ms"), "model", "left")
    a, b = q.alias("a"), q.alias("b")
    known = lambda c: F.col(f"a.{c}").isNotNull() & F.col(f"b.{c}").isNotNull()
    no_worse, better = F.col("b.mean_skill") >= F.col("a.mean_skill"), F.col("b.mean_skill") > F.col("a.mean_skill")
    for c in ("n_parameters", "latency_ms"):
        no_worse = no_worse & (~known(c) | (F.col(f"b.{c}") <= F.col(f"a.{c}")))
        better = better | (known(c) & (F.col(f"b.{c}") < F.col(f"a.{c}")))
    free = a.join(b, (F.col("a.model") != F.col("b.model")) & no_worse & better, "left_anti").select("model", F.lit(True).alias("_free"))
    return q.join(free, "model", "left").withColumn("pareto_optimal", F.coalesce("_free", F.lit(False))).drop("_free")


def _digits(n: int, v: Column) -> Column:
    """``n`` significant digits without trailing zeros."""
    text = F.regexp_replace(F.format_string(f"%.{n}g", v), r"(\.\d*?)0+(?=e|$)", "$1")
    return F.regexp_replace(text, r"\.(?=e|$)", "")


def _significant(v: Column) -> Column:
    """Three significant digits below 1000, else grouped whole numbers."""
    return F.when(F.abs(v) < 1000, _digits(3, v)).otherwise(F.format_number(v, 0))


def cell_text() -> Column:
    spread = F.when(F.col("std") > 0, F.concat(F.lit(" ±"), _digits(2, F.col("std")))).otherwise(F.lit(""))
    return F.concat(F.when(F.col("value").isNull(), F.lit("-")).otherwise(_significant(F.col("value"))), spread)


def wide_table(board: DataFrame) -> DataFrame:
    """One column of formatted cells per model."""
    rows = board.select(F.concat_ws(" · ", "task", "metric").alias("metric"), "protocol", "model", cell_text().alias("cell"))
    return rows.groupBy("metric", "protocol").pivot("model").agg(F.first("cell")).na.fill("n/a")


def reading(train: Column, test: Column) -> Column:
    return F.when(train.isNull() | test.isNull(), "").when(train <= FIT_MIN_SKILL, "not fitting") \
        .when((test <= FIT_MIN_SKILL) | (test < 0.5 * train), "not generalising").otherwise("consistent")


def train_vs_test(test: DataFrame, train: DataFrame, keys: list[str]) -> DataFrame:
    """Value and skill on both samples of every model, with a reading of the pair."""
    on = [*keys, "metric", "model"]
    part = lambda df, s: df.filter(~F.col("model").startswith("baseline:")).groupBy(*on).agg(
        F.avg("value").alias(f"value_{s}"), F.avg("skill").alias(f"skill_{s}"), F.max("n").alias(f"n_{s}"))
    both = part(train, "train").join(part(test, "test"), on)
    return both.withColumn("reading", reading(F.col("skill_train"), F.col("skill_test")))


def training_curves(history: DataFrame) -> DataFrame:
    """First, last and best losses per model from (model, epoch, train_loss, val_loss)."""
    h = history.filter(F.col("train_loss").isNotNull())
    e = F.col("epoch")
    best = F.min_by(F.struct("epoch", "val_loss"), F.struct(F.coalesce("val_loss", F.lit(float("inf"))), e))
    g = h.groupBy("model").agg(F.max("epoch").alias("epochs_run"), best.alias("b"),
                               F.min_by("train_loss", e).alias("train_loss_first"), F.max_by("train_loss", e).alias("train_loss_last"),
                               F.min_by(F.struct("val_loss"), e)["val_loss"].alias("val_loss_first"), F.max_by(F.struct("val_loss"), e)["val_loss"].alias("val_loss_last"))
    change = lambda a, b: F.when(F.col(a) != 0, (F.col(b) - F.col(a)) / F.abs(F.col(a)))
    return g.withColumns({"best_epoch": F.col("b.epoch"), "val_loss_best": F.col("b.val_loss")}).withColumns({
        "train_loss_change": change("train_loss_first", "train_loss_last"), "val_loss_change": change("val_loss_first", "val_loss_best")}).drop("b")


def paper_match(records: DataFrame, rules: DataFrame) -> DataFrame:
    """Level ('exact' or 'near') of the first rule whose model, metric and protocol agree and whose
    pattern matches the whole task. ``rules``: (rule, model, task_pattern, metric, protocol, level);
    the rule table is a hand-written list, so it is broadcast."""
    task = F.regexp_replace("task", "/linear_probe", "")
    r = F.broadcast(rules.withColumnRenamed("model", "r_model").withColumnRenamed("metric", "r_metric").withColumnRenamed("protocol", "r_protocol"))
    cond = (F.col("model") == F.col("r_model")) & (F.col("metric") == F.col("r_metric")) & (F.col("protocol") == F.col("r_protocol")) \
        & F.rlike(F.col("_task"), F.concat(F.lit("^(?:"), F.col("task_pattern"), F.lit(")$")))
    hits = records.withColumn("_task", task).join(r, cond).groupBy("task", "metric", "protocol", "model").agg(F.min_by("level", "rule").alias("paper_match"))
    return records.drop("paper_match").join(hits, ["task", "metric", "protocol", "model"], "left").withColumn("paper_match", F.coalesce("paper_match", F.lit("")))


IDENTITY = ["model", "run_tag", "task", "metric", "eval_seed", "protocol"]


def append_results(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Resume: records already present keep their place, the others are added."""
    return existing.unionByName(new.join(existing.select(*IDENTITY), IDENTITY, "left_anti"), allowMissingColumns=True)


def replace_results(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Re-run: new records replace those with the same identity."""
    return new.unionByName(existing.join(new.select(*IDENTITY), IDENTITY, "left_anti"), allowMissingColumns=True)


def best_marks(board: DataFrame, no_best: tuple[str, ...] = ()) -> DataFrame:
    """Best model and best overall (baselines included) per task and metric; ``no_best`` metrics have none."""
    score = F.when(F.col("higher_is_better"), F.col("value")).otherwise(-F.col("value"))
    rows = board.filter(F.col("value").isNotNull() & ~F.col("metric").isin(*no_best)).withColumn("_s", F.round(score, 9))
    is_model = ~F.col("model").startswith("baseline:")
    best = rows.groupBy("task", "metric", "protocol").agg(F.max("_s").alias("_all"), F.max(F.when(is_model, F.col("_s"))).alias("_models"))
    j = rows.join(best, ["task", "metric", "protocol"])
    return j.select("task", "metric", "protocol", "model", (F.col("_s") == F.col("_all")).alias("best_overall"),
                    (is_model & F.coalesce(F.col("_s") == F.col("_models"), F.lit(False))).alias("best_model"))
