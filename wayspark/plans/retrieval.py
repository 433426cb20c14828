"""Retrieval evaluations: half against half, one representation against another, and by what a window passes."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import union_all
from ..functions.draws import draw_int
from ..functions.ordered import global_rank
from ..operators import features, resample, retrieval, scores, splits, views

Embed = Callable[[DataFrame], DataFrame]          # long windows -> (window_id, vector)


def retrieval_sample(windows: DataFrame, db_size: int | None = None, n_queries: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Database windows and, among them, the query windows: all of them, or seeded draws where sizes are given."""
    db = windows if db_size is None else splits.seeded_subset(windows, "window_id", db_size, seed, "db")
    return db, db if n_queries is None else splits.seeded_subset(db, "window_id", n_queries, seed, "query")


def odd_even_eval(windows: DataFrame, lat0: float, lon0: float, db_size: int | None = None, n_queries: int | None = None, seed: int = 0,
                  ks=(1, 5, 10), embed=None) -> DataFrame:
    """Records of an embedding (``embed``: long windows -> (window_id, vector); position statistics by
    default) against Hausdorff and random ranking."""
    db, queries = retrieval_sample(windows, db_size, n_queries, seed)
    odd, even = views.odd_even_views(queries)[0], views.odd_even_views(db)[1]
    embed = embed or (lambda w: features.as_vector(features.location_features(w), features.PLACE))
    ranks = {"place": retrieval.cosine_ranks(embed(odd), embed(even), "window_id"),
             "baseline:hausdorff": retrieval.hausdorff_ranks(odd, even, lat0, lon0),
             "baseline:random": retrieval.random_ranks(queries.filter("pos = 0"), db.filter("pos = 0").count(), "window_id", seed)}
    samples = union_all([retrieval.rank_metrics(r, "window_id", ks).withColumn("model", F.lit(n)) for n, r in ranks.items()])
    keyed = samples.withColumnRenamed("window_id", "sample_id").withColumn("task", F.lit("retrieval/odd_even"))
    return scores.emit_records(keyed, ["task"], ["hausdorff", "random"])


def _records(ranks: dict[str, DataFrame], task: str, preferred: list[str], ks, n_boot: int, seed: int) -> DataFrame:
    samples = union_all([retrieval.rank_metrics(r, "window_id", ks).withColumn("model", F.lit(n)) for n, r in ranks.items()])
    return scores.emit_records(samples.withColumnRenamed("window_id", "sample_id").withColumn("task", F.lit(task)), ["task"], preferred, n_boot, seed)


def topology_points(windows: DataFrame, n: int = 200) -> DataFrame:
    """Key points of every window's curve, in long form."""
    rows = resample.topology(resample.resample_curve(views.window_arrays(windows), n))
    return rows.select("window_id", F.posexplode("topo").alias("pos", "p")).select("window_id", F.col("pos").cast("bigint").alias("pos"), "p.lat", "p.lon")


def cross_representation_eval(windows: DataFrame, queries: dict[str, Embed], database: Embed, lat0: float, lon0: float, db_size: int | None = None,
                              n_queries: int | None = None, ks=(1, 5, 10), n_boot: int = 0, seed: int = 0) -> DataFrame:
    """Records per representation: the window itself is looked for among the embeddings of all by an embedding of its topology, its regions or its
    roads. Ranked at random for comparison, and key points by Hausdorff distance to the windows."""
    db, asked = retrieval_sample(windows, db_size, n_queries, seed)
    known, n = database(db), db.filter("pos = 0").count()
    out = []
    for name, embed in queries.items():
        ranks = {"model": retrieval.cosine_ranks(embed(asked), known, "window_id"), "baseline:random": retrieval.random_ranks(asked.filter("pos = 0"), n, "window_id", seed)}
        if name == "topology":
            ranks["baseline:hausdorff"] = retrieval.hausdorff_ranks(topology_points(asked), db, lat0, lon0)
        out.append(_records(ranks, f"retrieval/cross_modal:{name}", ["hausdorff", "random"], ks, n_boot, seed))
    return union_all(out)


def random_top(queries: DataFrame, database: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """``k`` different database windows for every query, fixed by seed: (window_id, place, match). Windows are numbered, and a query takes steps of a drawn width
    from a drawn number on."""
    numbered = global_rank(database.select("window_id").distinct(), ["window_id"], "_rank")
    n = numbered.count()
    start, width = (F.pmod(draw_int(seed, salt, F.col("window_id")), F.lit(m)) for salt, m in (("top", max(n, 1)), ("step", max(n // k, 1))))
    places = F.explode(F.sequence(F.lit(0), F.lit(min(k, n) - 1))) if n else F.explode(F.array().cast("array<int>"))
    drawn = queries.select("window_id").distinct().withColumn("place", places).withColumn("_rank", 1 + F.pmod(start + F.col("place") * (1 + F.pmod(width, F.lit(max(n // k, 1)))), F.lit(max(n, 1))))
    return drawn.join(numbered.withColumnRenamed("window_id", "match"), "_rank").select("window_id", F.col("place").cast("bigint").alias("place"), "match")


def condition_eval(windows: DataFrame, elements: dict[str, DataFrame], queries: dict[str, Embed], database: Embed, db_size: int | None = None,
                   n_queries: int | None = None, n_boot: int = 0, seed: int = 0) -> DataFrame:
    """Records per kind of element (regions, roads): share of what a query passes that its best matches pass too, against drawn matches. Windows
    without such elements are no queries. ``elements``: distinct (window_id, element)."""
    db, asked = retrieval_sample(windows, db_size, n_queries, seed)
    known, out = database(db), []
    for name, embed in queries.items():
        own = elements[name].join(asked.select("window_id").distinct(), "window_id", "left_semi")
        some = asked.join(own.select("window_id").distinct(), "window_id", "left_semi")
        tops = {"model": retrieval.cosine_top(embed(some), known, "window_id", k=5), "baseline:random": random_top(some, db, 5, seed)}
        samples = union_all([retrieval.coverage(t, elements[name], "window_id").withColumn("model", F.lit(n)) for n, t in tops.items()])
        keyed = samples.withColumnRenamed("window_id", "sample_id").withColumn("task", F.lit(f"retrieval/condition:{name}"))
        out.append(scores.emit_records(keyed, ["task"], ["random"], n_boot, seed))
    return union_all(out)
