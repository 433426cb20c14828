"""Next-location evaluation: baselines and models on the same samples."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import union_all
from ..operators import location, probes, scores
from ..operators.grid import SquareGrid


def next_location_samples(train: DataFrame, test: DataFrame, grid: SquareGrid, models: dict[str, DataFrame]) -> DataFrame:
    """Long samples of the three baselines and of models given as sparse (sample_id, cell, p)."""
    base = location.LocationBaselines(train, grid.n_cells)
    ranked = {f"baseline:{n}": getattr(base, n)(test) for n in ("markov1", "user_frequent", "global_popular")}
    ranked.update({n: location.rank_scores(p, test, grid.n_cells) for n, p in models.items()})
    return union_all([location.location_metrics(r, grid).withColumn("model", F.lit(n)) for n, r in ranked.items()])


def next_location_eval(train: DataFrame, test: DataFrame, grid: SquareGrid, models: dict[str, DataFrame], n_boot: int = 0,
                       seed: int = 0, protocol: str = "native") -> DataFrame:
    samples = next_location_samples(train, test, grid, models)
    task = "next_location" if protocol == "native" else f"next_location/{protocol}"
    keyed = samples.withColumns({"task": F.lit(task), "protocol": F.lit(protocol)})
    return scores.emit_records(keyed, ["task", "protocol"], ["markov1", "user_frequent"], n_boot, seed)


def probe_eval(train: DataFrame, test: DataFrame, grid: SquareGrid, top_k: int, max_train: int = 100_000, n_boot: int = 0, seed: int = 0) -> DataFrame:
    """Records of the probe protocol: a linear model on frozen embeddings of the visits chooses among the ``top_k`` most visited training cells;
    ``probe_coverage`` is the share of targets among them, which its accuracy cannot exceed. The baselines see all cells.
    ``train``, ``test``: visits with an ``embedding``."""
    probs, cells = probes.location_probe(train, test, top_k, max_train, seed)
    own = location.candidate_metrics(probs, train, test, cells, grid).withColumn("model", F.lit("probe"))
    base = next_location_samples(train, test, grid, {})
    keyed = own.unionByName(base).withColumns({"task": F.lit("next_location/linear_probe"), "protocol": F.lit("linear_probe")})
    return scores.emit_records(keyed, ["task", "protocol"], ["markov1", "user_frequent"], n_boot, seed)
