"""Train / validation / test assignment, seeded subsets and their reports."""
from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw_hex
from ..functions.ordered import exact_percentiles, global_rank
from ..session import cut_lineage

NAMES = ("train", "val", "test")


def trip_table(points: DataFrame) -> DataFrame:
    return points.groupBy("traj_id").agg(
        F.min("user_id").alias("user_id"), F.min("t").alias("t_start"), F.max("t").alias("t_end"),
        F.count(F.lit(1)).alias("n_points"))


def _cuts(n: int, ratios) -> list[int]:
    """Half-to-even rounding of each share, accumulated."""
    first = round(ratios[0] * n)
    return [first, first + round(ratios[1] * n)]


def _by_rank(ranked: DataFrame, n: int, ratios) -> DataFrame:
    a, b = _cuts(n, ratios)
    label = F.when(F.col("_rank") <= a, "train").when(F.col("_rank") <= b, "val").otherwise("test")
    return ranked.withColumn("split", label).drop("_rank")


def split_by_time(points: DataFrame, ratios=(0.8, 0.1, 0.1)) -> DataFrame:
    """Trips in order of (start, id), cut at cumulative shares. One row per trip."""
    ranked = global_rank(trip_table(points), ["t_start", "traj_id"], "_rank")
    return _by_rank(ranked, ranked.count(), ratios)


def split_by_user(points: DataFrame, ratios=(0.8, 0.1, 0.1), seed: int = 0) -> DataFrame:
    """Users in seeded order, cut at cumulative shares. One row per user."""
    users = points.select("user_id").distinct().withColumn("_h", draw_hex(seed, "user", F.col("user_id")))
    ranked = global_rank(users, ["_h", "user_id"], "_rank").drop("_h")
    return _by_rank(ranked, ranked.count(), ratios)


def split_predefined(points: DataFrame, val_by: str = "time", val_fraction: float = 0.1, seed: int = 0) -> DataFrame:
    """Uses the ``split`` column; without validation rows they are carved out of train alone."""
    if "split" not in points.columns:
        raise ValueError("a predefined split needs a 'split' column")
    trips = points.groupBy("traj_id").agg(F.min("user_id").alias("user_id"), F.min("t").alias("t_start"),
                                          F.collect_set("split").alias("_sets"))
    facts = trips.agg(F.array_distinct(F.flatten(F.collect_set("_sets"))).alias("labels"),
                      F.sum((F.array_contains("_sets", "train") & F.array_contains("_sets", "test")).cast("int")).alias("both"))
    labels, both = facts.first()
    if not set(labels) <= set(NAMES) or not {"train", "test"} <= set(labels):
        raise ValueError(f"'split' must hold train and test (and optionally val), found {sorted(labels)}")
    if both:
        raise ValueError(f"{both} trajectories are in both train and test")
    trips = trips.withColumn("split", F.element_at("_sets", 1)).drop("_sets")
    if "val" in labels:
        return trips
    train = trips.filter("split = 'train'")
    if val_by == "user":
        users = train.select("user_id").distinct()
        k = max(1, round(val_fraction * users.count()))
        drawn = users.withColumn("_h", draw_hex(seed, "user", F.col("user_id")))
        chosen = global_rank(drawn, ["_h", "user_id"], "_rank").filter(F.col("_rank") <= k)
        held = train.join(chosen, "user_id", "left_semi").select("traj_id")
    elif val_by == "time":
        k = max(1, round(val_fraction * train.count()))
        n = train.count()
        held = global_rank(train, ["t_start", "traj_id"], "_rank").filter(F.col("_rank") > n - k).select("traj_id")
    else:
        raise ValueError("val_by must be 'time' or 'user'")
    held = held.withColumn("_val", F.lit(True))
    return trips.join(held, "traj_id", "left").withColumn(
        "split", F.when(F.col("_val"), "val").otherwise(F.col("split"))).drop("_val")


# ------------------------------------------------------------------ seeded subsets
DIGITS = 3              # of the hash, counted at a time: 4,096 rows


def drawn_keys(df: DataFrame, key: str, n: int, seed: int = 0, salt: str = "cap") -> DataFrame:
    """The first ``n`` distinct keys in hash order, the same way at every size: counts by the first digits of the hash tell up to which digits
    all keys belong to the draw; only the keys that share the border's six digits (one in 16 million) are sorted."""
    keys = cut_lineage(df.select(key).distinct().withColumn("_h", draw_hex(seed, salt, F.col(key))))
    border, left = "", n
    for _ in range(2):
        counts = keys.filter(F.col("_h").startswith(border)).groupBy(F.substring("_h", 1, len(border) + DIGITS).alias("d")).count().collect()
        for r in sorted(counts, key=lambda r: r["d"]):
            if r["count"] > left:
                border = r["d"]
                break
            left -= r["count"]
        else:
            return keys.select(key)                     # there are no more than n (a later border has more than ``left``)
    at = keys.filter(F.col("_h").startswith(border)).orderBy("_h", key).limit(left).select(key)
    return keys.filter(F.col("_h") < border).select(key).unionByName(at)


def seeded_subset(df: DataFrame, key: str, n: int, seed: int = 0, salt: str = "cap") -> DataFrame:
    """At most ``n`` rows per distinct ``key`` order by hash: a semi-join with the drawn keys."""
    return df.join(drawn_keys(df, key, n, seed, salt), key, "left_semi")


def trajectory_cap(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` whole trajectories."""
    return seeded_subset(points, "traj_id", n, seed, "traj")


def stratified_fraction(df: DataFrame, key: str, label: str, fraction: float, seed: int = 0) -> DataFrame:
    """Per class ``max(1, round(fraction * n))`` rows in seeded order.

    The cut inside a class is an order statistic of the hash, found by ranking over range chunks.
    """
    if fraction >= 1:
        return df
    from ..functions.ordered import numbered, range_chunks
    keys = df.select(label, key).withColumn("_h", draw_hex(seed, "strat", F.col(key)))
    sizes = keys.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    ranked = numbered(range_chunks(keys, [label, "_h", key]), [label], ["_h", key], "_r")
    want = F.greatest(F.lit(1), F.bround(F.col("_n") * fraction))
    chosen = ranked.join(sizes, label).filter(F.col("_r") <= want).select(key)
    return df.join(chosen, key, "left_semi")


# ------------------------------------------------------------------ reports
def fingerprint(trips: DataFrame, **view) -> DataFrame:
    """Order-free digest per split of its trip ids and of the parameters of the view (window length, gaps, ways to
    find stays): combines map-side, no list is ever gathered. Without parameters it is the digest of the trips alone."""
    h = F.md5("traj_id")
    part = lambda at: F.conv(F.substring(h, at, 15), 16, 10).cast("bigint")
    own = hashlib.md5("|".join(f"{k}={view[k]}" for k in sorted(view)).encode()).hexdigest() if view else "0" * 32
    mixed = lambda at: F.bit_xor(part(at)).bitwiseXOR(F.lit(int(own[at - 1:at + 14], 16)).cast("bigint"))
    return trips.groupBy("split").agg(mixed(1).alias("digest_a"), mixed(16).alias("digest_b"), F.count(F.lit(1)).alias("n_trips"))


def overlap_report(split_points: DataFrame) -> DataFrame:
    """Why trajectory ids occur in several split files: shares with the identical time span and size,
    and with overlapping spans, plus a diagnosis and duration percentiles. One row."""
    span = split_points.groupBy("traj_id", "split").agg(F.min("t").alias("lo"), F.max("t").alias("hi"),
                                                        F.count(F.lit(1)).alias("n"))
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    trip = span.groupBy("traj_id").agg(
        F.count(F.lit(1)).alias("k"), F.min_by(F.struct("lo", "hi", "n"), order).alias("a"),
        F.max_by(F.struct("lo", "hi", "n"), -F.when(order == F.lit(0), F.lit(9)).otherwise(order)).alias("b"),
        ((F.max("hi") - F.min("lo")) / 3600.0).alias("hours"))
    same = (F.col("a.lo") == F.col("b.lo")) & (F.col("a.hi") == F.col("b.hi")) & (F.col("a.n") == F.col("b.n"))
    meets = (F.col("a.lo") <= F.col("b.hi")) & (F.col("b.lo") <= F.col("a.hi"))
    shared = F.col("k") > 1
    counts = trip.agg(F.sum(shared.cast("bigint")).alias("n_shared"),
                      F.avg(F.when(shared, same.cast("double"))).alias("share_same"),
                      F.avg(F.when(shared, meets.cast("double"))).alias("share_overlap"))
    verdict = F.when(F.col("share_same") > 0.9, "same trips").when(F.col("share_overlap") < 0.1, "ids reused") \
        .otherwise("split by point")
    hours = exact_percentiles(trip, [], "hours", {"median_h": 0.5, "p99_h": 0.99})
    one = F.lit(1).alias("_one")
    return counts.select("*", one).join(hours.select("*", one), "_one").drop("_one").withColumn("diagnosis", verdict)


def resolve_overlap(split_points: DataFrame, policy: str = "error") -> DataFrame:
    """What to do with trajectory ids found in more than one split file."""
    per = split_points.select("traj_id", "split").distinct().groupBy("traj_id").agg(F.count(F.lit(1)).alias("_k"))
    shared = per.filter("_k > 1").select("traj_id")
    if policy == "error":
        if shared.limit(1).count():
            r = overlap_report(split_points).first()
            raise ValueError(f"{r['n_shared']} trajectories occur in more than one split file: {r['diagnosis']}")
        return split_points
    if policy == "drop_from_eval":
        flagged = split_points.join(shared.withColumn("_shared", F.lit(True)), "traj_id", "left")
        return flagged.filter(F.col("_shared").isNull() | (F.col("split") == "train")).drop("_shared") \
            .select(*split_points.columns)
    if policy == "separate":
        return split_points.withColumn("traj_id", F.concat_ws("/", "split", "traj_id"))
    raise ValueError("policy must be 'error', 'drop_from_eval' or 'separate'")


def pick_windows(windows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` windows from the half with the larger spatial extent, distinct users first."""
    from ..functions.geo import METRES_PER_DEGREE
    h = (F.max("lat") - F.min("lat")) * METRES_PER_DEGREE
    w = (F.max("lon") - F.min("lon")) * METRES_PER_DEGREE * F.cos(F.radians(F.avg("lat")))
    extent = windows.groupBy("window_id").agg(F.min("user_id").alias("user_id"), F.sqrt(h * h + w * w).alias("extent_m"))
    middle = exact_percentiles(extent, [], "extent_m", {"_m": 0.5}).first()[0]
    half = extent.filter(F.col("extent_m") >= middle).withColumn("_h", draw_hex(seed, "pick", F.col("window_id")))
    # the first window of each user comes before every second one; only n of either are ever needed
    first = half.groupBy("user_id").agg(F.min(F.struct("_h", "window_id", "extent_m")).alias("f"))
    heads = first.select("user_id", "f.*").withColumn("_second", F.lit(0))
    rest = half.join(heads.select("window_id"), "window_id", "left_anti").withColumn("_second", F.lit(1))
    return heads.unionByName(rest).orderBy("_second", "_h", "window_id").limit(n) \
        .select("window_id", "user_id", "extent_m")
