"""Recovery evaluation: masks x reconstructions x errors -> records."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import masks, recovery, scores
from ..operators.grid import SquareGrid

KEYS = ["task", "eval_seed", "window_id"]


def recovery_samples(windows: DataFrame, runs, length: int, grid: SquareGrid | None = None, with_dtw: bool = False,
                     predictions: dict[str, DataFrame] | None = None) -> DataFrame:
    """Per-window error samples of the baselines and of models given as prediction tables
    (task, eval_seed, window_id, pos, plat, plon)."""
    masked = masks.with_masks(windows, runs, length)
    table = recovery.reconstructions(masked, KEYS)
    pred = recovery.long_predictions(table, [*KEYS, "kind"], {
        "baseline:linear_interp": ("li_lat", "li_lon"), "baseline:last_observed": ("lo_lat", "lo_lon"),
        "baseline:constant_velocity": ("cv_lat", "cv_lon")})
    # dead reckoning is a baseline of prediction (hidden tail) only
    pred = pred.filter("kind = 'last' or model != 'baseline:constant_velocity'").drop("kind")
    for name, p in (predictions or {}).items():
        own = masked.select(*KEYS, "pos", "lat", "lon", "hidden").join(p, [*KEYS, "pos"], "left")
        pred = pred.unionByName(own.withColumn("model", F.lit(name)))
    errors = recovery.window_errors(pred, KEYS, grid)
    if with_dtw:
        errors = errors.join(recovery.window_dtw(pred, KEYS), [*KEYS, "model"])
    return recovery.error_samples(errors, KEYS)


def recovery_eval(windows: DataFrame, runs, length: int, grid: SquareGrid | None = None, with_dtw: bool = False,
                  predictions=None, n_boot: int = 0, seed: int = 0) -> DataFrame:
    samples = recovery_samples(windows, runs, length, grid, with_dtw, predictions)
    return scores.emit_records(samples, recovery.RUN, ["constant_velocity", "linear_interp"], n_boot, seed)
