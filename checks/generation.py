"""Generation statistics, divergences, copying, reference generators, reports (G, B15-B18, S11, H18, X7-X15)."""
from __future__ import annotations

from pyspark.sql import functions as F

from wayspark.functions.draws import draw_int, uniform
from wayspark.operators import continuous as C
from wayspark.operators import generation as G, location, masks, report, scores, splits
from wayspark.plans import generation as plan, train_eval

from .common import longs, rounded
from .inputs import LENGTH, Inputs, hav, sql, sql_cell, sql_draw, sql_hex, sql_normal, sql_uniform
from .recovery import RUNS, _shifted

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


def _points(d, split):
    return d.points().join(d.trips().filter(F.col("split") == split).select("traj_id"), "traj_id", "left_semi")


def _stays(d, split):
    return d.stays().filter(F.col("split") == split)


_ST = {
    "pts": (["points", "trips"], "SELECT p.*, t.split FROM points p JOIN trips t ON t.traj_id = p.traj_id"),
    "gs": (["pts", "stays", "grid"], f"""SELECT split, 'radius_of_gyration' AS stat, user_id, sqrt(avg(pow({hav('lat', 'lon', 'mlat', 'mlon')}, 2))) AS value FROM
          (SELECT *, avg(lat) OVER (PARTITION BY traj_id) AS mlat, avg(lon) OVER (PARTITION BY traj_id) AS mlon FROM pts) GROUP BY split, user_id, traj_id
        UNION ALL SELECT split, 'jump_length', user_id, j FROM (SELECT *, {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS j FROM stays WINDOW w AS (PARTITION BY split, user_id ORDER BY t_arrive, traj_id)) WHERE j IS NOT NULL
        UNION ALL SELECT split, 'stay_duration', user_id, (t_leave - t_arrive) / 60.0::DOUBLE FROM stays
        UNION ALL SELECT split, 'daily_locations', user_id, count(DISTINCT cell)::DOUBLE FROM (SELECT *, floor(t_arrive / 86400) AS d FROM stays) GROUP BY split, user_id, d"""),
    "q": (["gs"], "SELECT stat, quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi, max(value) AS mx FROM gs WHERE split = 'test' GROUP BY stat"),
    "edge": (["q"], """SELECT stat, k, pow(10.0::DOUBLE, log10(greatest(lo, 0.001)) + k * (log10(greatest(hi, greatest(lo, 0.001) * 10)) - log10(greatest(lo, 0.001))) / 30.0::DOUBLE) AS e FROM q, range(0, 31) r(k) WHERE stat <> 'daily_locations'
        UNION ALL SELECT stat, k, 0.5::DOUBLE + k FROM q, range(0, 200) r(k) WHERE stat = 'daily_locations' AND 0.5 + k < greatest(mx, 1) + 6.5"""),
    "hist": (["gs", "edge"], """SELECT split, stat, b AS bin, count(*) AS n FROM (SELECT g.split, g.stat, g.value, count(e.k) FILTER (WHERE e.e <= g.value) AS c, count(*) AS m FROM
          (SELECT *, row_number() OVER () AS rid FROM gs) g JOIN edge e ON e.stat = g.stat GROUP BY g.rid, g.split, g.stat, g.value) x, LATERAL (SELECT CASE WHEN stat = 'daily_locations' THEN c - 1 ELSE c END AS b)
        WHERE NOT (stat = 'daily_locations' AND (c = 0 OR c = m)) GROUP BY split, stat, b"""),
}


@query("G_stat", sql("SELECT stat, user_id, round(value, 4) AS value FROM gs WHERE split = 'test'", "gs", extra=_ST))
def g_stat(d):
    return rounded(G.trajectory_stats(_points(d, "test"), _stays(d, "test"), d.grid()), value=4)


def _values(d, split, stat):
    return G.trajectory_stats(_points(d, split), _stays(d, split), d.grid()).filter(F.col("stat") == stat)


@query("G_bins", sql("SELECT stat, CAST(bin AS BIGINT) AS bin, n FROM hist WHERE split = 'train' AND stat IN ('jump_length', 'daily_locations')", "hist", extra=_ST))
def g_bins(d):
    out = None
    for stat in ("jump_length", "daily_locations"):
        edges = G.bin_edges(_values(d, "test", stat), stat)
        h = G.histogram(_values(d, "train", stat), edges).select(F.lit(stat).alias("stat"), "bin", "n")
        out = h if out is None else out.unionByName(h)
    return out


@query("G_jsd", sql("""SELECT round(sum(CASE WHEN p > 0 THEN p * log2((p + 1e-12) / ((p + q) / 2 + 1e-12)) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * log2((q + 1e-12) / ((p + q) / 2 + 1e-12)) ELSE 0 END) / 2, 6) AS jsd FROM
   (SELECT bin, coalesce(sum(n) FILTER (WHERE split = 'test'), 0)::DOUBLE / (SELECT sum(n) FROM hist WHERE stat = 'radius_of_gyration' AND split = 'test') AS p,
      coalesce(sum(n) FILTER (WHERE split = 'train'), 0)::DOUBLE / (SELECT sum(n) FROM hist WHERE stat = 'radius_of_gyration' AND split = 'train') AS q FROM hist WHERE stat = 'radius_of_gyration' AND split IN ('train', 'test') GROUP BY bin)""", "hist", extra=_ST))
def g_jsd(d):
    real, train = _values(d, "test", "radius_of_gyration"), _values(d, "train", "radius_of_gyration")
    edges = G.bin_edges(real, "radius_of_gyration")
    return rounded(G.jsd(G.histogram(real, edges), G.histogram(train, edges)), jsd=6)


@query("G_jsd_cells", sql("""SELECT round(sum(CASE WHEN p > 0 THEN p * log2((p + 1e-12) / ((p + q) / 2 + 1e-12)) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * log2((q + 1e-12) / ((p + q) / 2 + 1e-12)) ELSE 0 END) / 2, 6) AS jsd FROM
   (SELECT cell, (count(*) FILTER (WHERE split = 'test'))::DOUBLE / (SELECT count(*) FROM stays WHERE split = 'test') AS p, (count(*) FILTER (WHERE split = 'train'))::DOUBLE / (SELECT count(*) FROM stays WHERE split = 'train') AS q FROM stays GROUP BY cell)""", "stays"))
def g_cells(d):
    return rounded(G.jsd(G.visited_cells(_stays(d, "test"), d.grid()), G.visited_cells(_stays(d, "train"), d.grid())), jsd=6)


@query("G_w1", sql("""SELECT round(sum(abs(ca::DOUBLE / nullif(na, 0) - cb::DOUBLE / nullif(nb, 0)) * (nx - value)), 4) AS w1 FROM (SELECT *, lead(value) OVER (ORDER BY value) AS nx, sum(a) OVER (ORDER BY value) AS ca, sum(b) OVER (ORDER BY value) AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM
   (SELECT value, count(*) FILTER (WHERE split = 'test') AS a, count(*) FILTER (WHERE split = 'train') AS b FROM gs WHERE stat = 'jump_length' AND split IN ('train', 'test') GROUP BY value))""", "gs", extra=_ST))
def g_w1(d):
    return rounded(G.wasserstein(_values(d, "test", "jump_length"), _values(d, "train", "jump_length")), w1=4)


@query("G_rho", sql("""SELECT CASE WHEN count(*) >= 5 THEN round(corr(rr, rg), 6) END AS rho, count(*) AS n_users FROM (SELECT (rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2.0::DOUBLE) AS rr,
    (rank() OVER (ORDER BY g) + (count(*) OVER (PARTITION BY g) - 1) / 2.0::DOUBLE) AS rg FROM (SELECT user_id, round(quantile_cont(value, 0.5) FILTER (WHERE split = 'test'), 6) AS r, round(quantile_cont(value, 0.5) FILTER (WHERE split = 'train'), 6) AS g
      FROM gs WHERE stat = 'radius_of_gyration' GROUP BY user_id HAVING count(*) FILTER (WHERE split = 'test') > 0 AND count(*) FILTER (WHERE split = 'train') > 0))""", "gs", extra=_ST))
def g_rho(d):
    part = lambda s: _values(d, s, "radius_of_gyration").withColumn("value", F.round("value", 6))
    return rounded(G.paired_spearman(part("test"), part("train")), rho=6)


_RS = {**_ST, "cnt": (["pts"], "SELECT split, traj_id, lat, lon, row_number() OVER (PARTITION BY traj_id ORDER BY t) - 1 AS p, count(*) OVER (PARTITION BY traj_id) AS n FROM pts"),
       "rs": (["cnt"], """SELECT split, traj_id, j, sum(CASE WHEN n = 1 THEN 1 ELSE greatest(1 - abs(j * (n - 1) / 15.0::DOUBLE - p), 0.0::DOUBLE) END * lat) AS lat, sum(CASE WHEN n = 1 THEN 1 ELSE greatest(1 - abs(j * (n - 1) / 15.0::DOUBLE - p), 0.0::DOUBLE) END * lon) AS lon
           FROM cnt, range(0, 16) r(j) GROUP BY split, traj_id, j"""),
       "nn": (["rs"], f"SELECT traj_id, min(d) AS d FROM (SELECT a.traj_id, b.traj_id AS o, avg({hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}) AS d FROM rs a JOIN rs b ON b.j = a.j WHERE a.split = 'test' AND b.split = 'train' GROUP BY a.traj_id, b.traj_id) GROUP BY traj_id")}


@query("G_copy_distance", sql("SELECT traj_id, round(d, 3) AS dist_m FROM nn", "nn", extra=_RS))
def g_copy(d):
    return rounded(G.nearest_train_distance(_points(d, "test"), _points(d, "train")), dist_m=3)


@query("G_copy_rate", sql("SELECT round(avg((d < (SELECT quantile_cont(d, 0.05) FROM nn))::INT::DOUBLE), 6) AS copy_rate, round(quantile_cont(d, 0.5), 3) AS nn_train_dist_m FROM nn", "nn", extra=_RS))
def g_rate(d):
    from wayspark.session import cut_lineage
    dist = cut_lineage(G.nearest_train_distance(_points(d, "test"), _points(d, "train")))
    threshold = G.exact_percentiles(dist, [], "dist_m", {"p": 0.05}).first()[0]
    v = scores.aggregate_values(G.copy_metrics(dist, threshold), [])
    w = v.groupBy().pivot("metric", ["copy_rate", "nn_train_dist_m"]).agg(F.first("value"))
    return rounded(w, copy_rate=6, nn_train_dist_m=3)


_GEN = {"tn": (["points"], "SELECT traj_id, row_number() OVER (ORDER BY traj_id) AS r, count(*) OVER () AS c FROM (SELECT DISTINCT traj_id FROM points)"),
        "dr": (["tn"], f"SELECT g.gen, tn.traj_id FROM range(0, 60) g(gen), tn WHERE tn.r = 1 + {sql_draw(3, 'trip', 'g.gen')} % tn.c"),
        "pc": (["points"], "SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY t) - 1 AS p, count(*) OVER (PARTITION BY traj_id) AS n FROM points"),
        "tn2": (["pc"], "SELECT traj_id, row_number() OVER (ORDER BY traj_id) AS r, count(*) OVER () AS c FROM (SELECT DISTINCT traj_id FROM pc WHERE n >= 6)"),
        "dr2": (["tn2"], f"SELECT g.gen, t.traj_id FROM range(0, 60) g(gen), tn2 t WHERE t.r = 1 + {sql_draw(3, 'trip', 'g.gen')} % t.c")}


@query("B15_uniform_bbox", sql(f"""SELECT user_id, concat('gen', CAST(gen AS VARCHAR)) AS traj_id, t, round(la + (lb - la) * {sql_uniform(3, 'lat', 'gen', 'stop')} + 1e-4 * {sql_normal(3, 'lat.n', 'gen', 'p')}, 7) AS lat,
     round(oa + (ob - oa) * {sql_uniform(3, 'lon', 'gen', 'stop')} + 1e-4 * {sql_normal(3, 'lon.n', 'gen', 'p')}, 7) AS lon FROM
    (SELECT *, CAST(CASE WHEN p < (n % k) * (n // k + 1) THEN p // (n // k + 1) ELSE n % k + (p - (n % k) * (n // k + 1)) // greatest(n // k, 1) END AS BIGINT) AS stop FROM
      (SELECT pc.*, dr.gen, 2 + {sql_draw(3, 'stops', 'dr.gen')} % 3 AS k FROM pc JOIN dr ON dr.traj_id = pc.traj_id)), (SELECT min(lat) AS la, max(lat) AS lb, min(lon) AS oa, max(lon) AS ob FROM points)""", "pc", "dr", extra=_GEN))
def b15(d):
    return rounded(G.uniform_bbox(d.points(), 60, 3), lat=7, lon=7)


@query("B16_seed_only", sql("""SELECT x.user_id, concat('seed', CAST(gen AS VARCHAR)) AS traj_id, x.t, CASE WHEN x.p >= 5 THEN l.lat ELSE x.lat END AS lat, CASE WHEN x.p >= 5 THEN l.lon ELSE x.lon END AS lon FROM pc x JOIN dr2 ON dr2.traj_id = x.traj_id
    JOIN pc l ON l.traj_id = x.traj_id AND l.p = 4""", "pc", "dr2", extra=_GEN))
def b16(d):
    return G.seed_only(d.points(), 60, 3)


@query("B17_real_noise_floor", sql(f"""SELECT stat, round(avg(value), 4) AS mean, count(*) AS n FROM (SELECT 'radius_of_gyration' AS stat, sqrt(avg(pow({hav('lat', 'lon', 'mlat', 'mlon')}, 2))) AS value FROM
      (SELECT *, avg(lat) OVER (PARTITION BY traj_id) AS mlat, avg(lon) OVER (PARTITION BY traj_id) AS mlon FROM pts WHERE split = 'train') WHERE traj_id IN
        (SELECT traj_id FROM (SELECT DISTINCT traj_id FROM pts WHERE split = 'train') ORDER BY {sql_hex(0, 'traj', 'traj_id')}, traj_id LIMIT 100) GROUP BY traj_id) GROUP BY stat""", "pts", extra=_ST))
def b17(d):
    floor = splits.trajectory_cap(_points(d, "train"), 100, 0)
    s = G.trajectory_stats(floor, _stays(d, "train"), d.grid()).filter("stat = 'radius_of_gyration'")
    return rounded(s.groupBy("stat").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n")), mean=4)


@query("B18_jitter_copy", sql(f"""SELECT p.user_id, concat('gen', CAST(gen AS VARCHAR)) AS traj_id, p.t, round(lat + 2e-4 * {sql_normal(3, 'jitter.lat', 'gen', 'CAST(p.t AS BIGINT)')}, 7) AS lat, round(lon + 3e-4 * {sql_normal(3, 'jitter.lon', 'gen', 'CAST(p.t AS BIGINT)')}, 7) AS lon
    FROM points p JOIN dr ON dr.traj_id = p.traj_id""", "points", "dr", extra=_GEN))
def b18(d):
    return rounded(G.jitter_copy(d.points(), 60, 3), lat=7, lon=7)


@query("S11_trajectory_cap", sql(f"""SELECT traj_id, t FROM points WHERE traj_id IN (SELECT traj_id FROM (SELECT DISTINCT traj_id FROM points) ORDER BY {sql_hex(5, 'traj', 'traj_id')}, traj_id LIMIT 70)""", "points"))
def s11(d):
    return splits.trajectory_cap(d.points(), 70, 5).select("traj_id", "t")


@query("H18_generation_eval")
def h18(d):
    train = _points(d, "train")
    n = d.trips().filter("split = 'test'").count()        # every side has as many trips as the test data
    floor = splits.trajectory_cap(train, n, 0)
    floor_stays = _stays(d, "train").join(floor.select("traj_id").distinct(), "traj_id", "left_semi")
    return plan.generation_eval(_points(d, "test"), _stays(d, "test"), floor, floor_stays, G.uniform_bbox(train, n, 0), G.jitter_copy(train, n, 0), train, d.grid())


@query("H19_train_eval")
def h19(d):
    # all recovery runs; the train sample is capped at the reference's default of evaluated samples
    models = lambda w: {"shifted": _noisy(w, RUNS)}
    return train_eval.recovery_train_eval(d.windows(), RUNS, LENGTH, d.grid(), 2000, models)


@query("H19_next_location")
def h19_location(d):
    return train_eval.next_location_train_eval(d.visits(), d.grid(), 2000, lambda v: {"recency": location.recency_scores(v).select("sample_id", "cell", F.col("score").alias("p"))})


@query("H19_continuous")
def h19_continuous(d):
    return train_eval.continuous_train_eval(d.visits(), "duration", 2000, {"own_context": lambda v: C.own_context_mixture(v, "duration")})


def _noisy(windows, runs):
    wid, pos = F.col("window_id"), F.col("pos")
    m = masks.with_masks(windows, runs, LENGTH)
    return m.select("task", "eval_seed", "window_id", "pos", (F.col("lat") + (uniform(9, "dlat", wid, pos) - 0.5) * 0.004).alias("plat"),
                    (F.col("lon") + (uniform(9, "dlon", wid, pos) - 0.5) * 0.004).alias("plon"))


# ------------------------------------------------------------------ reports over records derived from the events
_NAMES = "['ade_m', 'acc@1', 'crps_min', 'macro_f1', 'n_parameters', 'latency_ms_per_sample']"
_FAMS = "['recovery', 'location', 'continuous', 'classification', 'efficiency', 'efficiency']"
_REC = {"rec": ([], f"""SELECT * FROM (SELECT event_id, CASE WHEN user_id % 5 = 4 THEN 'baseline:simple' ELSE concat('m', CAST(user_id % 5 AS VARCHAR)) END AS model, CAST(event_id % 2 AS VARCHAR) AS run_tag,
         ({_NAMES})[1 + event_id % 6] AS metric, ({_FAMS})[1 + event_id % 6] AS family, concat('task', CAST(event_id // 6 % 2 AS VARCHAR)) AS task, 'native' AS protocol, value AS value,
         CASE WHEN user_id % 5 = 4 THEN NULL ELSE {sql_uniform(1, 'skill', 'event_id')} * 3 - 1.5 END AS skill, CASE WHEN user_id % 5 = 4 THEN NULL ELSE 'simple' END AS baseline, event_id % 3 AS eval_seed, event_id % 100 AS n,
         (event_id % 6) IN (1, 3) AS higher FROM events)""")}


def _records(d):
    return _records_from(d.table("events"))


def _records_from(events, *keep):
    """Result records derived from the events table: metric, task, seed and tag from the ids."""
    e, u = F.col("event_id"), F.col("user_id")
    pick = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), (1 + e % 6).cast("int"))
    base = u % 5 == 4
    return events.select(
        *keep, F.when(base, "baseline:simple").otherwise(F.concat(F.lit("m"), (u % 5).cast("string"))).alias("model"), (e % 2).cast("string").alias("run_tag"),
        pick(("ade_m", "acc@1", "crps_min", "macro_f1", "n_parameters", "latency_ms_per_sample")).alias("metric"),
        pick(("recovery", "location", "continuous", "classification", "efficiency", "efficiency")).alias("family"),
        F.concat(F.lit("task"), (F.floor(e / 6) % 2).cast("string")).alias("task"), F.lit("native").alias("protocol"), F.col("value").alias("value"),
        F.when(~base, uniform(1, "skill", e) * 3 - 1.5).alias("skill"), F.when(~base, "simple").alias("baseline"), (e % 3).alias("eval_seed"), (e % 100).alias("n"),
        (e % 6).isin(1, 3).alias("higher_is_better"), F.lit("").alias("unit"), F.lit(None).cast("string").alias("paper_match"),
        *[F.lit(None).cast("double").alias(c) for c in ("ci_low", "ci_high", "skill_ci_low", "skill_ci_high")])


@query("X7_leaderboard", sql("SELECT family, task, metric, protocol, model, round(avg(value), 5) AS value, round(stddev_samp(value), 5) AS std, round(avg(skill), 6) AS skill, count(*) AS n_runs, max(n) AS n, min(baseline) AS baseline FROM rec GROUP BY ALL HAVING count(*) > 0", "rec", extra=_REC).replace("GROUP BY ALL", "GROUP BY family, task, metric, protocol, model"))
def x7(d):
    b = report.leaderboard(_records(d)).select("family", "task", "metric", "protocol", "model", "value", "std", "skill", "n_runs", "n", "baseline")
    return rounded(b, value=5, std=5, skill=6)


_FAM = {**_REC, "fl": (["rec"], """SELECT model, family, quantile_cont(s, 0.5) AS skill FROM (SELECT model, family, task, metric, avg(least(greatest(skill, -1), 1)) AS s FROM rec WHERE model NOT LIKE 'baseline:%' AND skill IS NOT NULL AND family <> 'efficiency' GROUP BY ALL) GROUP BY ALL""")}


@query("X8_family_summary", sql("""SELECT model, round(max(skill) FILTER (WHERE family = 'classification'), 6) AS classification, round(max(skill) FILTER (WHERE family = 'continuous'), 6) AS continuous, round(max(skill) FILTER (WHERE family = 'location'), 6) AS location,
    round(max(skill) FILTER (WHERE family = 'recovery'), 6) AS recovery FROM fl GROUP BY model""", "fl", extra=_FAM))
def x8(d):
    return rounded(report.family_summary(_records(d)), classification=6, continuous=6, location=6, recovery=6)


@query("X9_pareto_front", sql(""", q AS (SELECT f.model, avg(f.skill) AS s, any_value(p.v) AS p, any_value(l.v) AS l FROM fl f LEFT JOIN (SELECT model, avg(value) AS v FROM rec WHERE metric = 'n_parameters' GROUP BY model) p USING (model)
      LEFT JOIN (SELECT model, avg(value) AS v FROM rec WHERE metric = 'latency_ms_per_sample' GROUP BY model) l USING (model) GROUP BY f.model)
    SELECT a.model, round(a.s, 6) AS mean_skill, round(a.p, 5) AS n_parameters, round(a.l, 5) AS latency_ms, NOT EXISTS (SELECT 1 FROM q b WHERE b.model <> a.model AND b.s >= a.s AND b.p <= a.p AND b.l <= a.l AND (b.s > a.s OR b.p < a.p OR b.l < a.l)) AS pareto_optimal FROM q a""", "fl", "rec", extra=_FAM))
def x9(d):
    return rounded(report.pareto_front(_records(d)), mean_skill=6, n_parameters=5, latency_ms=5)


@query("X10_wide_table", sql("""SELECT concat(task, ' · ', metric) AS metric, protocol, coalesce(max(CASE WHEN model = 'm0' THEN c END), 'n/a') AS m0, coalesce(max(CASE WHEN model = 'm1' THEN c END), 'n/a') AS m1 FROM
    (SELECT task, metric, protocol, model, CAST(n AS VARCHAR) AS c FROM (SELECT task, metric, protocol, model, count(*) AS n FROM rec GROUP BY ALL)) GROUP BY task, metric, protocol""", "rec", extra=_REC))
def x10(d):
    b = report.leaderboard(_records(d)).withColumns({"value": F.col("n_runs").cast("double"), "std": F.lit(None).cast("double")})
    return report.wide_table(b).select("metric", "protocol", "m0", "m1")


@query("X11_train_vs_test", sql("""SELECT *, CASE WHEN skill_train IS NULL OR skill_test IS NULL THEN '' WHEN skill_train <= 0.02 THEN 'not fitting' WHEN skill_test <= 0.02 OR skill_test < 0.5 * skill_train THEN 'not generalising' ELSE 'consistent' END AS reading FROM
   (SELECT family, task, protocol, metric, model, round(avg(value) FILTER (WHERE run_tag = '0'), 5) AS value_train, round(avg(value) FILTER (WHERE run_tag = '1'), 5) AS value_test, round(avg(skill) FILTER (WHERE run_tag = '0'), 6) AS skill_train,
      round(avg(skill) FILTER (WHERE run_tag = '1'), 6) AS skill_test, max(n) FILTER (WHERE run_tag = '0') AS n_train, max(n) FILTER (WHERE run_tag = '1') AS n_test FROM rec2 WHERE model NOT LIKE 'baseline:%' GROUP BY family, task, protocol, metric, model
      HAVING count(*) FILTER (WHERE run_tag = '0') > 0 AND count(*) FILTER (WHERE run_tag = '1') > 0)""", "rec2", extra={**_REC, "rec2": (["rec"], "SELECT * REPLACE (CASE WHEN event_id % 5 < 2 THEN '0' ELSE '1' END AS run_tag) FROM rec")}))
def x11(d):
    tagged = _records_from(d.table("events").withColumn("part", (F.col("event_id") % 5 >= 2).cast("int")), "part")
    t = report.train_vs_test(tagged.filter("part = 1"), tagged.filter("part = 0"), ["family", "task", "protocol"])
    return rounded(t, value_train=5, value_test=5, skill_train=6, skill_test=6)


@query("X12_training_curves", sql("""SELECT model, max(epoch) AS epochs_run, arg_min(epoch, (val, epoch)) AS best_epoch, round(arg_min(train, epoch), 6) AS train_loss_first, round(arg_max(train, epoch), 6) AS train_loss_last, round(min(val), 6) AS val_loss_best FROM
    (SELECT CAST(user_id % 7 AS VARCHAR) AS model, floor(epoch_day) AS epoch, avg(value) AS train, avg(value) + 0.1 * (epoch_day % 3) AS val FROM (SELECT *, CAST(date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS BIGINT) AS epoch_day FROM events) GROUP BY user_id % 7, epoch_day)
    GROUP BY model""".replace("floor(epoch_day) AS epoch", "epoch_day AS epoch")))
def x12(d):
    day = F.datediff(F.to_date("ts"), F.lit("2020-01-01").cast("date")).cast("bigint")
    h = d.table("events").groupBy((F.col("user_id") % 7).cast("string").alias("model"), day.alias("epoch")).agg(F.avg("value").alias("train_loss"))
    h = h.withColumn("val_loss", F.col("train_loss") + 0.1 * (F.col("epoch") % 3))
    c = report.training_curves(h).select("model", "epochs_run", "best_epoch", "train_loss_first", "train_loss_last", "val_loss_best")
    return rounded(c, train_loss_first=6, train_loss_last=6, val_loss_best=6)


@query("X13_paper_match", sql("""SELECT model, run_tag, task, metric, eval_seed, CASE WHEN model = 'm0' AND metric = 'ade_m' AND regexp_matches(task, '^task[01]$') THEN 'near' WHEN model = 'm1' AND metric = 'acc@1' AND task = 'task1' THEN 'exact' ELSE '' END AS paper_match, count(*) AS k FROM rec GROUP BY ALL""", "rec", extra=_REC))
def x13(d):
    rules = d.spark.createDataFrame([(1, "m0", "task[01]", "ade_m", "native", "near"), (2, "m1", "task1", "acc@1", "native", "exact"), (3, "m0", "task1", "ade_m", "native", "exact")],
                                    "rule int, model string, task_pattern string, metric string, protocol string, level string")
    m = report.paper_match(_records(d), rules)
    return m.groupBy("model", "run_tag", "task", "metric", "eval_seed", "paper_match").agg(F.count(F.lit(1)).alias("k"))


_DED = {**_REC, "one": (["rec"], "SELECT model, run_tag, task, metric, eval_seed, protocol, arg_min(value, event_id) AS v0, arg_max(value, event_id) AS v1, min(event_id) AS e0 FROM rec GROUP BY ALL")}


@query("X14_results_dedup", sql("SELECT model, run_tag, task, metric, eval_seed, CASE WHEN eval_seed < 2 THEN v0 ELSE v1 END AS value FROM one", "one", extra=_DED))
def x14(d):
    ids = ["model", "run_tag", "task", "metric", "eval_seed", "protocol"]
    r = _records_from(d.table("events"), "event_id").groupBy(*ids).agg(F.min_by("value", "event_id").alias("v0"), F.max_by("value", "event_id").alias("v1"))
    old = r.filter("eval_seed < 2").select(*ids, F.col("v0").alias("value"))
    new = r.select(*ids, F.col("v1").alias("value"))
    return report.append_results(old, new).select("model", "run_tag", "task", "metric", "eval_seed", "value")


@query("X15_best_marks", sql(""", b AS (SELECT task, metric, model, round(avg(value) * CASE WHEN any_value(higher) THEN 1 ELSE -1 END, 9) AS s FROM rec WHERE metric <> 'n_parameters' GROUP BY task, metric, model)
    SELECT task, metric, model, s = max(s) OVER (PARTITION BY task, metric) AS best_overall, model NOT LIKE 'baseline:%' AND s = max(CASE WHEN model NOT LIKE 'baseline:%' THEN s END) OVER (PARTITION BY task, metric) AS best_model FROM b""", "rec", extra=_REC))
def x15(d):
    return report.best_marks(report.leaderboard(_records(d)), ("n_parameters",)).select("task", "metric", "model", "best_overall", "best_model")
