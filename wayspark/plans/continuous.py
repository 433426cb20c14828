"""Travel-time and duration evaluation."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import union_all
from ..operators import continuous as C
from ..operators import scores


def continuous_eval(train: DataFrame, validation: DataFrame, test: DataFrame, target: str,
                    models: dict[str, Callable[[DataFrame], DataFrame]], travel_max_min: float | None = C.TRAVEL_MAX_MIN,
                    reveal: tuple[str, ...] = (), n_boot: int = 0, seed: int = 0) -> DataFrame:
    """Records of models against the training marginal. A model maps samples to the same samples with
    a ``mixture`` (in seconds) or a ``point`` (in seconds); point models get a pseudo likelihood with
    the spread of their validation residuals."""
    from ..functions.normal import rescale
    y = {n: C.target_minutes(v, target, travel_max_min) for n, v in (("train", train), ("val", validation), ("test", test))}
    upper = C.support_max(y["train"])
    median, mix = C.train_marginal(y["train"], seed=seed)
    marginal = C.constant_mixture(y["test"].withColumn("point", F.lit(median)), mix)
    parts = {"baseline:train_marginal": C.mixture_metrics(marginal, ["sample_id"], upper)}
    for name, model in models.items():
        out = model(y["test"])
        if "mixture" in out.columns:
            out = out.withColumn("mixture", rescale(F.col("mixture"), 1 / 60.0))
            parts[name] = C.mixture_metrics(out, ["sample_id"], upper)
        else:
            minutes = lambda v: model(v).withColumn("point", F.col("point") / 60.0)
            sigma = C.residual_sigma(minutes(y["val"]))
            rows = minutes(y["test"])
            parts[name] = union_all([C.point_metrics(rows, ["sample_id"]), C.pseudo_nll(rows, ["sample_id"], sigma),
                                     C.point_within(rows, ["sample_id"], upper)])
    task = f"continuous/{target}" + (f"|given:{'+'.join(reveal)}" if reveal else "")
    if target == "travel_time" and travel_max_min is not None:
        task += f"|<={travel_max_min / 60:g}h"
    samples = union_all([p.withColumn("model", F.lit(n)) for n, p in parts.items()]).withColumn("task", F.lit(task))
    return scores.emit_records(samples, ["task"], ["train_marginal"], n_boot, seed)
