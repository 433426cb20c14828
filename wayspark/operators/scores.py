"""From per-sample values to records: aggregates, skill, bootstrap intervals, flags."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import exact_percentiles
from ..functions.registry import metric_rows, with_spec
from ..functions.resamples import weighted_quantiles, weighted_sums
from ..session import cut_lineage

_HOW = {r[0]: r[8] for r in metric_rows()}


def melt(df: DataFrame, keys: list[str], metrics: dict[str, Column | str]) -> DataFrame:
    """Wide per-sample metrics to (keys, metric, value) rows."""
    pairs = [F.struct(F.lit(n).alias("metric"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("value"))
             for n, c in metrics.items()]
    return df.select(*keys, F.explode(F.array(*pairs)).alias("m")).select(*keys, "m.metric", "m.value")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def _how(metric: Column) -> Column:
    """Aggregate of a metric name, as a literal map (57 entries)."""
    base = F.split(metric, ":")[0]
    special = [n for n, h in _HOW.items() if h != "mean"]
    out = F.lit("mean")
    for n in special:
        out = F.when(base == n, _HOW[n]).otherwise(out)
    return out


def aggregate_values(samples: DataFrame, keys: list[str], written: bool = False) -> DataFrame:
    """(keys, metric, value, n) from finite per-sample values; means combine map-side, medians and
    90th percentiles go through ranked counts. ``written``: the samples are already a table."""
    rows = samples if written else cut_lineage(samples.select(*keys, "metric", "value"))
    rows = rows.filter(finite(F.col("value"))).withColumn("_how", _how(F.col("metric")))
    groups = [*keys, "metric"]
    mean = F.avg("value")
    value = F.when(F.first("_how") == "rmse", F.sqrt(mean)).otherwise(mean)
    plain = rows.filter("_how in ('mean', 'rmse')").groupBy(*groups).agg(value.alias("value"), F.count(F.lit(1)).alias("n"))
    ordered = rows.filter("_how in ('median', 'p90')")
    p = exact_percentiles(ordered, [*groups, "_how"], "value", {"p50": 0.5, "p90": 0.9})
    sizes = ordered.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    ranked = p.withColumn("value", F.when(F.col("_how") == "median", F.col("p50")).otherwise(F.col("p90"))) \
        .join(sizes, groups).select(*groups, "value", "n")
    return plain.unionByName(ranked)


def skill_score(value: Column, baseline: Column, kind: Column, floor: Column | None = None) -> Column:
    """Unit-free comparison with a baseline on the same samples; null where undefined."""
    usable = finite(value) & finite(baseline)
    by_floor = F.lit(None).cast("double")
    if floor is not None:
        by_floor = F.when(baseline - floor > 1e-12, (baseline - value) / (baseline - floor))
    return F.when(usable, F.when(kind == "ratio", F.when(baseline > 0, 1 - value / baseline))
                  .when(kind == "bounded", F.when(baseline < 1, (value - baseline) / (1 - baseline)))
                  .when(kind == "difference", baseline - value)
                  .when(kind == "floor", by_floor))


def bootstrap_values(samples: DataFrame, keys: list[str], n_boot: int, seed: int = 0) -> DataFrame:
    """Metric value on each of ``n_boot`` resamples: (keys, metric, rep, value).

    Poisson bootstrap: a sample's weights are Poisson(1) draws of (seed, sample, replicate), so models and baselines share
    their resamples without any exchange. A task draws a sample's weights as one vector and adds vectors (``functions/resamples.py``);
    samples are never copied by replicate. A replicate that drew no sample of a group has no value. Interval ends differ slightly from a
    multinomial bootstrap.
    """
    rows = samples.filter(finite(F.col("value"))).withColumn("_how", _how(F.col("metric")))
    groups = [*keys, "metric"]
    sums = weighted_sums(rows.filter("_how in ('mean', 'rmse')"), [*groups, "_how"], n_boot, seed)
    each = sums.select(*groups, "_how", F.posexplode(F.arrays_zip("w", "wv")).alias("rep", "s")).filter("s.w > 0")
    mean = F.col("s.wv") / F.col("s.w")
    plain = each.select(*groups, "rep", F.when(F.col("_how") == "rmse", F.sqrt(mean)).otherwise(mean).alias("value"))
    ordered = rows.filter("_how in ('median', 'p90')").withColumn("_q", F.when(F.col("_how") == "median", 0.5).otherwise(0.9))
    return plain.unionByName(weighted_quantiles(ordered, groups, "_q", n_boot, seed))


def interval(reps: DataFrame, keys: list[str], value: str, prefix: str, alpha: float = 0.05) -> DataFrame:
    """Percentile interval over replicates (a fixed, small number per group)."""
    ends = F.percentile(value, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return reps.filter(finite(F.col(value))).groupBy(*keys).agg(ends.alias("_e")).select(
        *keys, F.col("_e")[0].alias(prefix + "low"), F.col("_e")[1].alias(prefix + "high"))


def bootstrap_ci(samples: DataFrame, keys: list[str], n_boot: int = 1000, seed: int = 0) -> DataFrame:
    samples = cut_lineage(samples.select(*keys, "sample_id", "metric", "value"))
    return interval(bootstrap_values(samples, keys, n_boot, seed), [*keys, "metric"], "value", "ci_")


def preferred_baseline(values: DataFrame, keys: list[str], preferred: list[str]) -> DataFrame:
    """Per (keys, metric) the first baseline of ``preferred`` that has the metric."""
    rank = F.lit(len(preferred))
    for i, name in reversed(list(enumerate(preferred))):
        rank = F.when(F.col("model") == f"baseline:{name}", i).otherwise(rank)
    own = values.withColumn("_rank", rank).filter(F.col("_rank") < len(preferred))
    best = own.groupBy(*keys, "metric").agg(F.min_by(F.struct("model", "value"), "_rank").alias("_b"))
    return best.select(*keys, "metric", F.expr("substring(_b.model, 10)").alias("baseline"),
                       F.col("_b.value").alias("baseline_value"))


def emit_records(samples: DataFrame, keys: list[str], preferred: list[str], n_boot: int = 0, seed: int = 0) -> DataFrame:
    """Records of models and baselines: value, interval, preferred baseline, skill and flags.

    ``samples``: (keys, model, sample_id, metric, value); baselines are models named 'baseline:<x>'.
    """
    groups = [*keys, "model"]
    samples = cut_lineage(samples.select(*groups, "sample_id", "metric", "value"))      # read by every branch below
    values = cut_lineage(aggregate_values(samples, groups, written=True))
    base = preferred_baseline(values, keys, preferred)
    is_base = F.col("model").startswith("baseline:")
    out = values.join(base, [*keys, "metric"], "left")
    out = out.withColumns({c: F.when(~is_base, F.col(c)) for c in ("baseline", "baseline_value")})
    out = with_spec(out)
    out = out.withColumn("skill", skill_score(F.col("value"), F.col("baseline_value"), F.col("skill_kind")))
    if n_boot:
        reps = cut_lineage(bootstrap_values(samples, groups, n_boot, seed))
        out = out.join(interval(reps, [*groups, "metric"], "value", "ci_"), [*groups, "metric"], "left")
        out = out.join(paired_skill_ci(reps, out, keys), [*groups, "metric"], "left")
    return out.withColumn("flags", sanity_flags()).drop("aggregate", "skill_kind", "low", "high", "plausible_max")


def paired_skill_ci(reps: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Interval of the skill: model and baseline on the same resample, replicate by replicate."""
    pairs = records.filter("baseline is not null").select(*keys, "metric", "model", "baseline", "skill_kind")
    model = reps.join(pairs, [*keys, "metric", "model"])
    base = reps.withColumnsRenamed({"value": "_b"}).withColumn("baseline", F.expr("substring(model, 10)")) \
        .filter(F.col("model").startswith("baseline:")).drop("model")
    both = model.join(base, [*keys, "metric", "rep", "baseline"])
    both = both.withColumn("_s", skill_score(F.col("value"), F.col("_b"), F.col("skill_kind")))
    return interval(both, [*keys, "model", "metric"], "_s", "skill_ci_")


def sanity_flags(value: Column | None = None) -> Column:
    """Non-finite, outside the valid range, implausibly large (registry columns in scope)."""
    v = F.col("value") if value is None else value
    bad = ~finite(v)
    outside = F.coalesce(v < F.col("low") - 1e-9, F.lit(False)) | F.coalesce(v > F.col("high") + 1e-9, F.lit(False))
    large = F.coalesce(v > F.col("plausible_max"), F.lit(False))
    return F.when(bad, F.array(F.lit("non-finite value"))).otherwise(F.array_compact(F.array(
        F.when(outside, F.lit("outside valid range")), F.when(large, F.lit("implausibly large")))))
