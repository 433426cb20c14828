"""The same evaluation on a capped training sample, compared with the test result."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.report import train_vs_test
from .continuous import continuous_eval
from .info import split_view
from .next_location import next_location_eval
from .recovery import recovery_eval


def recovery_train_eval(windows: DataFrame, runs, length: int, grid, cap: int, models) -> DataFrame:
    """``models(windows)`` gives the predictions for whichever windows are scored."""
    test = windows.filter("split = 'test'")
    train = split_view(windows, "train", "window_id", cap)
    keys = ["task", "eval_seed"]
    score = lambda w: recovery_eval(w, runs, length, grid, predictions=models(w))
    return train_vs_test(score(test), score(train), keys)


def visit_train_eval(visits: DataFrame, cap: int, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``score(visits)`` on the test visits and on a capped draw of the training visits, compared by task."""
    return train_vs_test(score(visits.filter("split = 'test'")), score(split_view(visits, "train", "sample_id", cap)), ["task"])


def next_location_train_eval(visits: DataFrame, grid, cap: int, models: Callable[[DataFrame], dict[str, DataFrame]]) -> DataFrame:
    """``models(visits)`` gives the sparse scores for whichever visits are scored; baselines know the training visits."""
    train = visits.filter("split = 'train'")
    return visit_train_eval(visits, cap, lambda v: next_location_eval(train, v, grid, models(v)))


def continuous_train_eval(visits: DataFrame, target: str, cap: int, models: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    part = {s: visits.filter(f"split = '{s}'") for s in ("train", "val")}
    return visit_train_eval(visits, cap, lambda v: continuous_eval(part["train"], part["val"], v, target, models))
