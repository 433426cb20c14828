"""Masks, resampling, naive reconstructions and recovery metrics (M, T, B1-B3, R, X1-X6, H1)."""
from __future__ import annotations

from pyspark.sql import functions as F

from wayspark.functions.draws import uniform
from wayspark.operators import grid as G
from wayspark.operators import masks, recovery, resample, scores, views
from wayspark.plans import recovery as plan

from .common import longs, rounded
from .core import _REGION
from .inputs import LENGTH, Inputs, hav, sql, sql_cell, sql_draw, sql_hex, sql_uniform

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


RUNS = masks.recovery_runs(("random", "block"), (0.5,), (0, 1), (("last", 2), ("keep_every", 4)))


def _test(d):
    return d.windows().filter("split = 'test'")


_MASK = {
    "wt": (["win"], "SELECT * FROM win WHERE split = 'test'"),
    "runs": ([], """SELECT * FROM (VALUES ('recovery/random@0.5', 'random', 0, 4), ('recovery/random@0.5', 'random', 1, 4), ('recovery/block@0.5', 'block', 0, 4),
        ('recovery/block@0.5', 'block', 1, 4), ('recovery/last:2', 'last', 0, 2), ('recovery/keep_every:4', 'keep_every', 0, 4)) v(task, kind, eval_seed, k)"""),
    "masked": (["wt", "runs"], f"""SELECT *, CASE kind WHEN 'random' THEN pos BETWEEN 1 AND 6 AND row_number() OVER (PARTITION BY task, eval_seed, window_id ORDER BY h NULLS LAST, pos) <= k
         WHEN 'block' THEN pos >= s AND pos < s + k WHEN 'last' THEN pos >= 8 - k ELSE pos % k <> 0 AND pos <> 7 END AS hidden FROM
       (SELECT wt.*, runs.*, CASE WHEN pos BETWEEN 1 AND 6 THEN md5(concat_ws('|', CAST(eval_seed AS VARCHAR), 'mask', window_id, CAST(pos AS VARCHAR))) END AS h,
          1 + CAST('0x' || substr(md5(concat_ws('|', CAST(eval_seed AS VARCHAR), 'block', window_id)), 1, 15) AS BIGINT) % (7 - k) AS s FROM wt, runs)"""),
    # neighbours on both sides of every position
    "nb": (["masked"], """SELECT m.*, (SELECT count(*) FROM masked o WHERE o.task = m.task AND o.eval_seed = m.eval_seed AND o.window_id = m.window_id AND NOT o.hidden) AS n_seen,
         last_value(CASE WHEN NOT hidden THEN pos END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pa,
         first_value(CASE WHEN NOT hidden THEN pos END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pb,
         max(CASE WHEN NOT hidden THEN pos END) OVER (PARTITION BY task, eval_seed, window_id) AS pz FROM masked m
         WINDOW w AS (PARTITION BY task, eval_seed, window_id ORDER BY pos)"""),
    "ny": (["nb"], "SELECT *, max(CASE WHEN NOT hidden AND pos < pz THEN pos END) OVER (PARTITION BY task, eval_seed, window_id) AS py FROM nb"),
    "rec": (["ny"], """SELECT n.task, n.kind, n.eval_seed, n.window_id, n.pos, n.t, n.lat, n.lon, n.hidden,
         CASE WHEN NOT n.hidden THEN n.lat WHEN a.t IS NULL THEN b.lat WHEN b.t IS NULL THEN a.lat ELSE (b.lat - a.lat)/(b.t - a.t)*(n.t - a.t) + a.lat END AS li_lat,
         CASE WHEN NOT n.hidden THEN n.lon WHEN a.t IS NULL THEN b.lon WHEN b.t IS NULL THEN a.lon ELSE (b.lon - a.lon)/(b.t - a.t)*(n.t - a.t) + a.lon END AS li_lon,
         CASE WHEN NOT n.hidden THEN n.lat ELSE a.lat END AS lo_lat, CASE WHEN NOT n.hidden THEN n.lon ELSE a.lon END AS lo_lon,
         CASE WHEN n.hidden AND n.pos > n.pz THEN z.lat + (n.t - z.t)/(z.t - y.t)*(z.lat - y.lat) END AS x_lat,
         CASE WHEN n.hidden AND n.pos > n.pz THEN z.lon + (n.t - z.t)/(z.t - y.t)*(z.lon - y.lon) END AS x_lon
       FROM ny n LEFT JOIN wt a ON a.window_id = n.window_id AND a.pos = n.pa LEFT JOIN wt b ON b.window_id = n.window_id AND b.pos = n.pb
       LEFT JOIN wt z ON z.window_id = n.window_id AND z.pos = n.pz LEFT JOIN wt y ON y.window_id = n.window_id AND y.pos = n.py"""),
    "pred": (["rec"], f"""SELECT task, eval_seed, window_id, pos, lat, lon, hidden, 'baseline:linear_interp' AS model, li_lat AS plat, li_lon AS plon FROM rec
       UNION ALL SELECT task, eval_seed, window_id, pos, lat, lon, hidden, 'baseline:last_observed', lo_lat, lo_lon FROM rec
       UNION ALL SELECT task, eval_seed, window_id, pos, lat, lon, hidden, 'baseline:constant_velocity', coalesce(x_lat, li_lat), coalesce(x_lon, li_lon) FROM rec WHERE kind = 'last'
       UNION ALL SELECT task, eval_seed, window_id, pos, lat, lon, hidden, 'shifted', lat + ({sql_uniform(9, 'dlat', 'window_id', 'pos')} - 0.5::DOUBLE) * 0.004,
          lon + ({sql_uniform(9, 'dlon', 'window_id', 'pos')} - 0.5::DOUBLE) * 0.004 FROM rec"""),
    "err": (["pred", "grid"], f"""SELECT task, eval_seed, window_id, model, avg(d) AS ade_m, avg(d * d) AS rmse_m, avg(CASE WHEN is_end THEN d END) AS fde_m,
        avg(CASE WHEN d <= 100 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS acc_100m, avg(CASE WHEN d <= 500 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS acc_500m, avg(CASE WHEN pc = tc THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS grid_acc FROM
       (SELECT p.*, {hav('plat', 'plon', 'lat', 'lon')} AS d, {sql_cell('plat', 'plon')} AS pc, {sql_cell('lat', 'lon')} AS tc,
          hidden AND NOT coalesce(lead(hidden) OVER (PARTITION BY task, eval_seed, window_id, model ORDER BY pos), false) AS is_end FROM pred p, grid g)
       WHERE hidden GROUP BY ALL"""),
    "agg": (["err"], """SELECT task, eval_seed, model, count(*) AS n, avg(ade_m) AS a1, quantile_cont(ade_m, 0.5) AS a2, quantile_cont(ade_m, 0.9) AS a3, sqrt(avg(rmse_m)) AS a4,
        avg(fde_m) AS a5, avg(acc_100m) AS a6, avg(acc_500m) AS a7, avg(grid_acc) AS a8 FROM err GROUP BY ALL"""),
    "vals": (["agg"], """SELECT task, eval_seed, model, n, m.metric, m.value FROM (SELECT *, unnest([{'metric': 'ade_m', 'value': a1}, {'metric': 'median_ade_m', 'value': a2},
        {'metric': 'p90_ade_m', 'value': a3}, {'metric': 'rmse_m', 'value': a4}, {'metric': 'fde_m', 'value': a5}, {'metric': 'acc_100m', 'value': a6},
        {'metric': 'acc_500m', 'value': a7}, {'metric': 'grid_acc', 'value': a8}]) AS m FROM agg)"""),
    "recs": (["vals"], """SELECT *, CASE WHEN baseline IS NULL OR baseline_value IS NULL THEN NULL WHEN metric IN ('acc_100m', 'acc_500m', 'grid_acc') THEN CASE WHEN baseline_value < 1 THEN (value - baseline_value)/(1 - baseline_value) END
        WHEN baseline_value > 0 THEN 1 - value / baseline_value END AS skill FROM
       (SELECT v.*, CASE WHEN v.model = 'shifted' THEN CASE WHEN v.task = 'recovery/last:2' THEN 'constant_velocity' ELSE 'linear_interp' END END AS baseline, b.value AS baseline_value
        FROM vals v LEFT JOIN vals b ON v.model = 'shifted' AND b.task = v.task AND b.eval_seed = v.eval_seed AND b.metric = v.metric
          AND b.model = CASE WHEN v.task = 'recovery/last:2' THEN 'baseline:constant_velocity' ELSE 'baseline:linear_interp' END)"""),
}


def _sql(body, *needs):
    return sql(body, *needs, extra=_MASK)


def _masked(d):
    return masks.with_masks(_test(d), RUNS, LENGTH)


def _mask_query(kind):
    return lambda d: longs(_masked(d).filter(F.col("kind") == kind).select("task", "eval_seed", "window_id", "pos", "hidden"), "eval_seed")


for _id, _kind in (("M1_mask_random", "random"), ("M2_mask_block", "block"), ("M3_mask_last", "last"), ("M4_mask_keep_every", "keep_every")):
    query(_id, _sql(f"SELECT task, CAST(eval_seed AS BIGINT) AS eval_seed, window_id, pos, hidden FROM masked WHERE kind = '{_kind}'", "masked"))(_mask_query(_kind))


@query("M7_block_ends", _sql("""SELECT task, CAST(eval_seed AS BIGINT) AS eval_seed, window_id, pos FROM (SELECT *, hidden AND NOT coalesce(lead(hidden) OVER
    (PARTITION BY task, eval_seed, window_id ORDER BY pos), false) AS e FROM masked) WHERE e""", "masked"))
def m7(d):
    ends = masks.block_ends(_masked(d), plan.KEYS)
    return longs(ends.filter("is_end").select("task", "eval_seed", "window_id", "pos"), "eval_seed")


_RDP = {
    "seg0": (["win"], """SELECT a.window_id, a.pos AS s, b.pos AS e, m.pos AS i,
        CASE WHEN pow(b.lon - a.lon, 2) + pow(b.lat - a.lat, 2) = 0 THEN sqrt(pow(m.lon - a.lon, 2) + pow(m.lat - a.lat, 2))
        ELSE abs((b.lon - a.lon) * (m.lat - a.lat) - (b.lat - a.lat) * (m.lon - a.lon)) / sqrt(pow(b.lon - a.lon, 2) + pow(b.lat - a.lat, 2)) END AS d
        FROM win a JOIN win b ON b.window_id = a.window_id AND b.pos > a.pos + 1 JOIN win m ON m.window_id = a.window_id AND m.pos > a.pos AND m.pos < b.pos"""),
    "seg1": (["seg0"], "SELECT window_id, s, e, arg_max(i, (d, -i)) AS i, max(d) AS d FROM seg0 GROUP BY ALL"),
    "split0": (["seg1"], """SELECT window_id, s, e, i FROM seg1 WHERE s = 0 AND e = 7 AND d > 0.0001 UNION ALL
        SELECT c.window_id, c.s, c.e, c.i FROM split0 p JOIN seg1 c ON c.window_id = p.window_id AND c.d > 0.0001 AND ((c.s = p.s AND c.e = p.i) OR (c.s = p.i AND c.e = p.e))"""),
    "kp": (["split0", "win"], """SELECT w.window_id, w.pos, w.pos IN (0, 7) OR EXISTS (SELECT 1 FROM split0 x WHERE x.window_id = w.window_id AND x.i = w.pos) AS key FROM win w"""),
    "mixs": (["kp"], f"""SELECT *, CASE WHEN u < 0.7 THEN 'random' WHEN u < 0.85 THEN 'rdp' WHEN u < 0.9 THEN 'block' ELSE 'last_n' END AS strategy FROM
        (SELECT window_id, pos, key, {sql_uniform(4, 'strategy', 'window_id')} AS u, least(5 + {sql_draw(4, 'size', 'window_id')} % 10, 8) AS bs,
           {sql_draw(4, 'start', 'window_id')} AS st, 3 + {sql_draw(4, 'tail', 'window_id')} % 5 AS tail, {sql_hex(4, 'fill', 'window_id', 'pos')} AS h FROM kp)"""),
    "mixc": (["mixs"], """SELECT *, CASE strategy WHEN 'rdp' THEN key AND pos BETWEEN 1 AND 6 WHEN 'block' THEN pos >= st % (8 - bs + 1) AND pos < st % (8 - bs + 1) + bs
          WHEN 'last_n' THEN pos >= 8 - tail ELSE false END AS c0 FROM mixs"""),
    "mixd": (["mixc"], """SELECT *, c0 AND (strategy <> 'rdp' OR row_number() OVER (PARTITION BY window_id ORDER BY CASE WHEN c0 THEN 0 ELSE 1 END, h) <= 4) AS c1 FROM mixc"""),
    "mixf": (["mixd"], """SELECT window_id, pos, strategy, c1 OR row_number() OVER (PARTITION BY window_id ORDER BY CASE WHEN c1 THEN 1 ELSE 0 END, h) <=
          4 - sum(CASE WHEN c1 THEN 1 ELSE 0 END) OVER (PARTITION BY window_id) AS hidden FROM mixd"""),
}


@query("T3_rdp_keypoints", sql("SELECT window_id, pos, key FROM kp", "kp", extra=_RDP))
def t3(d):
    return resample.keypoints(views.window_arrays(d.windows()), "window_id", 1e-4)


@query("M5_mask_strategy_mix", sql("SELECT window_id, pos, strategy, hidden FROM mixf", "mixf", extra=_RDP))
def m5(d):
    keys = resample.keypoints(views.window_arrays(d.windows()), "window_id", 1e-4)
    return masks.mask_strategy_mix(d.windows(), keys, LENGTH, 0.5, 4).select("window_id", "pos", "strategy", "hidden")


@query("M6_mask_spans", sql(f""", c AS (SELECT window_id, pos, CASE WHEN row_number() OVER (PARTITION BY window_id ORDER BY {sql_hex(6, 'cut', 'window_id', 'pos')}) <= 2 AND pos > 0 THEN 1 ELSE 0 END AS cut FROM win),
   s AS (SELECT *, sum(cut) OVER (PARTITION BY window_id ORDER BY pos) AS span, sum(cut) OVER (PARTITION BY window_id) + 1 AS spans FROM c),
   h AS (SELECT *, dense_rank() OVER (PARTITION BY window_id ORDER BY md5(concat_ws('|', '6', 'span', window_id, CAST(CAST(span AS BIGINT) AS VARCHAR)))) <= ceil(spans * 0.4::DOUBLE) AS sh,
      {sql_uniform(6, 'feature', 'window_id', 'pos')} < 0.2 AS pick, {sql_uniform(6, 'which', 'window_id', 'pos')} < 0.5 AS sp FROM s)
   SELECT window_id, pos, sh OR (pick AND sp) AS hidden_spatial, sh OR (pick AND NOT sp) AS hidden_temporal FROM h""", "win"))
def m6(d):
    return masks.mask_spans(d.windows(), LENGTH, 6).select("window_id", "pos", "hidden_spatial", "hidden_temporal")


# ------------------------------------------------------------------ B1-B3, R
def _recon(d):
    return recovery.reconstructions(_masked(d), plan.KEYS)


for _id, _p in (("B1_linear_interpolation", "li"), ("B3_last_observed", "lo")):
    query(_id, _sql(f"""SELECT task, CAST(eval_seed AS BIGINT) AS eval_seed, window_id, pos, round({_p}_lat, 8) AS lat, round({_p}_lon, 8) AS lon FROM rec WHERE hidden""", "rec"))(
        lambda d, p=_p: longs(_recon(d).filter("hidden").select("task", "eval_seed", "window_id", "pos",
                              F.round(f"{p}_lat", 8).alias("lat"), F.round(f"{p}_lon", 8).alias("lon")), "eval_seed"))


@query("B2_constant_velocity", _sql("""SELECT task, window_id, pos, round(coalesce(x_lat, li_lat), 8) AS lat, round(coalesce(x_lon, li_lon), 8) AS lon FROM rec WHERE hidden AND kind = 'last'""", "rec"))
def b2(d):
    return _recon(d).filter("hidden and kind = 'last'").select("task", "window_id", "pos", F.round("cv_lat", 8).alias("lat"), F.round("cv_lon", 8).alias("lon"))


def _shifted(d):
    """A model as a predictions table: the truth moved by up to 0.002 degrees."""
    wid, pos = F.col("window_id"), F.col("pos")
    return _masked(d).select(*plan.KEYS, "pos", (F.col("lat") + (uniform(9, "dlat", wid, pos) - 0.5) * 0.004).alias("plat"),
                             (F.col("lon") + (uniform(9, "dlon", wid, pos) - 0.5) * 0.004).alias("plon"))


def _pred(d):
    pred = recovery.long_predictions(_recon(d), [*plan.KEYS, "kind"], {
        "baseline:linear_interp": ("li_lat", "li_lon"), "baseline:last_observed": ("lo_lat", "lo_lon"),
        "baseline:constant_velocity": ("cv_lat", "cv_lon")})
    own = _masked(d).select(*plan.KEYS, "pos", "lat", "lon", "hidden").join(_shifted(d), [*plan.KEYS, "pos"])
    return pred.filter("kind = 'last' or model != 'baseline:constant_velocity'").drop("kind").unionByName(own.withColumn("model", F.lit("shifted")))


def _errors(*columns):
    names = ", ".join(f"round({c}, 4) AS {c}" for c in columns)
    oracle = _sql(f"SELECT task, CAST(eval_seed AS BIGINT) AS eval_seed, window_id, model, {names} FROM err", "err")

    def build(d):
        e = recovery.window_errors(_pred(d), plan.KEYS, d.grid()).select("task", "eval_seed", "window_id", "model", *columns)
        return longs(rounded(e, **{c: 4 for c in columns}), "eval_seed")
    return oracle, build


for _id, _cols in (("R_ade", ("ade_m", "rmse_m")), ("R_fde", ("fde_m",)), ("R_acc", ("acc_100m", "acc_500m")), ("R_grid", ("grid_acc",))):
    _o, _b = _errors(*_cols)
    query(_id, _o)(_b)


_DTW = {**_MASK,
    "hp": (["pred"], "SELECT *, row_number() OVER (PARTITION BY task, eval_seed, window_id, model ORDER BY pos) - 1 AS h, count(*) OVER (PARTITION BY task, eval_seed, window_id, model) AS k FROM pred WHERE hidden"),
    "cost": (["hp"], f"""SELECT a.task, a.eval_seed, a.window_id, a.model, any_value(a.k) AS k, list({hav('a.plat', 'a.plon', 'b.lat', 'b.lon')} ORDER BY a.h, b.h) AS c
        FROM hp a JOIN hp b ON a.task = b.task AND a.eval_seed = b.eval_seed AND a.window_id = b.window_id AND a.model = b.model GROUP BY a.task, a.eval_seed, a.window_id, a.model"""),
    "dtw": (["cost"], """SELECT task, eval_seed, window_id, model, k, c, 1 AS n, [c[1]] AS d, [1.0::DOUBLE] AS l FROM cost UNION ALL
        SELECT task, eval_seed, window_id, model, k, c, n + 1, list_append(d, c[n + 1] + CASE WHEN dg <= up AND dg <= lf THEN dg WHEN up <= lf THEN up ELSE lf END),
           list_append(l, 1 + CASE WHEN dg <= up AND dg <= lf THEN l[n - k] WHEN up <= lf THEN l[n + 1 - k] ELSE l[n] END) FROM
          (SELECT *, CASE WHEN n >= k AND n % k > 0 THEN d[n - k] ELSE 1e300::DOUBLE END AS dg, CASE WHEN n >= k THEN d[n + 1 - k] ELSE 1e300::DOUBLE END AS up,
             CASE WHEN n % k > 0 THEN d[n] ELSE 1e300::DOUBLE END AS lf FROM dtw WHERE n < k * k)"""),
}


@query("R_dtw", sql("SELECT task, CAST(eval_seed AS BIGINT) AS eval_seed, window_id, model, round(d[n] / l[n], 4) AS dtw_m FROM dtw WHERE n = k * k", "dtw", extra=_DTW))
def r_dtw(d):
    return longs(rounded(recovery.window_dtw(_pred(d), plan.KEYS), dtw_m=4), "eval_seed")


# ------------------------------------------------------------------ X, H1
@query("X1_aggregate", _sql("SELECT task, CAST(eval_seed AS BIGINT) AS eval_seed, model, metric, round(value, 4) AS value, n FROM vals", "vals"))
def x1(d):
    s = recovery.error_samples(recovery.window_errors(_pred(d), plan.KEYS, d.grid()), plan.KEYS)
    return longs(rounded(scores.aggregate_values(s, ["task", "eval_seed", "model"]), value=4), "eval_seed")


@query("H1_recovery_eval", _sql("""SELECT task, CAST(eval_seed AS BIGINT) AS eval_seed, model, metric, round(value, 4) AS value, n, baseline, round(baseline_value, 4) AS baseline_value, round(skill, 5) AS skill FROM recs""", "recs"))
def h1(d):
    r = plan.recovery_eval(_test(d), RUNS, LENGTH, d.grid(), predictions={"shifted": _shifted(d)})
    out = r.select("task", "eval_seed", "model", "metric", "value", "n", "baseline", "baseline_value", "skill")
    return longs(rounded(out, value=4, baseline_value=4, skill=5), "eval_seed")


@query("X3_skill_score", _sql("""SELECT task, CAST(eval_seed AS BIGINT) AS eval_seed, metric, round(skill, 5) AS skill FROM recs WHERE model = 'shifted'""", "recs"))
def x3(d):
    return longs(h1(d).filter("model = 'shifted'").select("task", "eval_seed", "metric", "skill"), "eval_seed")


@query("X5_sanity_flags", sql("""SELECT metric, value, CASE WHEN value IS NULL OR isinf(value) THEN 'non-finite value' ELSE concat_ws('; ',
      CASE WHEN value < lo - 1e-9 OR value > hi + 1e-9 THEN 'outside valid range' END, CASE WHEN value > pm THEN 'implausibly large' END) END AS flags FROM
    (SELECT 'ade_m' AS metric, value, 0.0 AS lo, NULL::DOUBLE AS hi, 20000.0 AS pm FROM v UNION ALL SELECT 'acc_100m', value / 1000, 0, 1, NULL FROM v
     UNION ALL SELECT 'mape', value / 10, 0, NULL, 10 FROM v)""", "v", extra={"v": (["points"], "SELECT CASE WHEN t % 7 = 0 THEN NULL ELSE floor((t - 1704067200) / 10) - 2000 END AS value FROM points")}))
def x5(d):
    v = d.points().select(F.when(F.col("t") % 7 != 0, F.floor((F.col("t") - 1704067200) / 10) - 2000).cast("double").alias("value"))
    rows = scores.melt(v, [], {"ade_m": "value", "acc_100m": F.col("value") / 1000, "mape": F.col("value") / 10})
    from wayspark.functions.registry import with_spec
    return with_spec(rows).select("metric", "value", F.array_join(scores.sanity_flags(), "; ").alias("flags"))


@query("X6_emit_records", _sql("""SELECT task, CAST(eval_seed AS BIGINT) AS eval_seed, model, metric, baseline FROM recs""", "recs"))
def x6(d):
    return h1(d).select("task", "eval_seed", "model", "metric", "baseline")


# weights of every sample in 1,000 replicates: SplitMix64 from a hash of the sample, then the Poisson(1) distribution function
_CDF = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253,
        0.9999988747974020, 0.9999998885745217, 0.9999999899522336)
_64 = "% 18446744073709551616::UHUGEINT"
_BOOT = {**_MASK,
    "bi": (["err"], "SELECT window_id, CAST('0x' || substr(md5(concat_ws('|', '0', 'boot', CAST(window_id AS VARCHAR))), 1, 16) AS UBIGINT)::UHUGEINT AS s FROM (SELECT DISTINCT window_id FROM err)"),
    "b0": (["bi"], f"SELECT window_id, rep, CAST((s + (rep + 1)::UHUGEINT * 11400714819323198485::UHUGEINT) {_64} AS UBIGINT) AS z FROM bi, range(0, 1000) r(rep)"),
    "b1": (["b0"], f"SELECT window_id, rep, CAST((xor(z, z >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) {_64} AS UBIGINT) AS z FROM b0"),
    "b2": (["b1"], f"SELECT window_id, rep, CAST((xor(z, z >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) {_64} AS UBIGINT) AS z FROM b1"),
    "b3": (["b2"], "SELECT window_id, rep, CAST(xor(z, z >> 31) >> 11 AS DOUBLE) / 9007199254740992.0::DOUBLE AS u FROM b2"),
    "bw": (["b3"], "SELECT * FROM (SELECT window_id, rep, (CASE " + " ".join(f"WHEN u < {c}::DOUBLE THEN {k}" for k, c in enumerate(_CDF)) + " ELSE 11 END) AS w FROM b3) WHERE w > 0"),
    "bl": (["bw", "err"], """SELECT task, eval_seed, model, rep, metric, v FROM (SELECT task, eval_seed, model, rep, sum(w * ade_m) / sum(w) AS ade_m, sum(w * fde_m) / sum(w) AS fde_m, sqrt(sum(w * rmse_m) / sum(w)) AS rmse_m,
            sum(w * acc_100m) / sum(w) AS acc_100m, sum(w * acc_500m) / sum(w) AS acc_500m, sum(w * grid_acc) / sum(w) AS grid_acc FROM err JOIN bw USING (window_id) GROUP BY ALL)
        UNPIVOT (v FOR metric IN (ade_m, fde_m, rmse_m, acc_100m, acc_500m, grid_acc))
        UNION ALL SELECT task, eval_seed, model, rep, unnest(['median_ade_m', 'p90_ade_m']), unnest(q) FROM (SELECT task, eval_seed, model, rep, quantile_cont(ade_m, [0.5, 0.9]) AS q
            FROM (SELECT task, eval_seed, model, rep, ade_m, unnest(range(0, w)) FROM err JOIN bw USING (window_id)) GROUP BY task, eval_seed, model, rep)"""),
}


def _all_samples(d):
    return recovery.error_samples(recovery.window_errors(_pred(d), plan.KEYS, d.grid()), plan.KEYS)


@query("X2_bootstrap_ci", sql("""SELECT task, CAST(eval_seed AS BIGINT) AS eval_seed, model, metric, round(quantile_cont(v, 0.025), 4) AS ci_low, round(quantile_cont(v, 0.975), 4) AS ci_high FROM bl GROUP BY ALL""", "bl", extra=_BOOT))
def x2(d):
    """All tasks, seeds and metrics with the reference's default of replicates."""
    return longs(rounded(scores.bootstrap_ci(_all_samples(d), ["task", "eval_seed", "model"], 1000, 0), ci_low=4, ci_high=4), "eval_seed")


@query("X4_paired_skill_ci", sql("""SELECT task, CAST(eval_seed AS BIGINT) AS eval_seed, model, metric, round(quantile_cont(s, 0.025), 5) AS skill_ci_low, round(quantile_cont(s, 0.975), 5) AS skill_ci_high FROM
    (SELECT m.task, m.eval_seed, m.model, m.metric, CASE WHEN m.metric IN ('acc_100m', 'acc_500m', 'grid_acc') THEN CASE WHEN b.v < 1 THEN (m.v - b.v) / (1 - b.v) END WHEN b.v > 0 THEN 1 - m.v / b.v END AS s
     FROM bl m JOIN bl b ON b.task = m.task AND b.eval_seed = m.eval_seed AND b.rep = m.rep AND b.metric = m.metric AND b.model = 'baseline:linear_interp' WHERE m.model NOT LIKE 'baseline:%') GROUP BY ALL""", "bl", extra=_BOOT))
def x4(d):
    r = scores.emit_records(_all_samples(d), ["task", "eval_seed"], ["linear_interp"], 1000, 0)
    r = r.filter("baseline is not null").select("task", "eval_seed", "model", "metric", "skill_ci_low", "skill_ci_high")
    return longs(rounded(r, skill_ci_low=5, skill_ci_high=5), "eval_seed")


# ------------------------------------------------------------------ T
@query("T1_resample_index", sql("""SELECT traj_id, CAST(j AS BIGINT) AS j, round(sum(greatest(1 - abs(j * (n - 1) / 15.0::DOUBLE - p), 0.0::DOUBLE) * lat), 7) AS lat,
     round(sum(greatest(1 - abs(j * (n - 1) / 15.0::DOUBLE - p), 0.0::DOUBLE) * lon), 7) AS lon FROM
    (SELECT traj_id, lat, lon, row_number() OVER (PARTITION BY traj_id ORDER BY t) - 1 AS p, count(*) OVER (PARTITION BY traj_id) AS n FROM points) x, range(0, 16) r(j)
    WHERE n > 1 GROUP BY traj_id, j UNION ALL
    SELECT traj_id, j, round(lat, 7), round(lon, 7) FROM (SELECT traj_id, min(lat) AS lat, min(lon) AS lon FROM points GROUP BY traj_id HAVING count(*) = 1), range(0, 16) r(j)""", "points"))
def t1(d):
    return rounded(resample.resample_index(d.points(), 16), lat=7, lon=7)


_ARR = {"arr": (["segs"], "SELECT traj_id, seg, list(lat ORDER BY t) AS y, count(*) AS n FROM segs GROUP BY ALL HAVING count(*) >= 3"),
    "dd": (["arr"], "SELECT *, list_transform(range(1, n), lambda i: y[i + 1] - y[i]) AS d FROM arr"),
    "sl": (["dd"], """SELECT *, list_transform(range(1, n + 1), lambda i: CASE
        WHEN i = 1 THEN CASE WHEN (3*d[1] - d[2])/2 * d[1] <= 0 THEN 0.0::DOUBLE WHEN d[1]*d[2] < 0 AND abs((3*d[1] - d[2])/2) > 3*abs(d[1]) THEN 3*d[1] ELSE (3*d[1] - d[2])/2 END
        WHEN i = n THEN CASE WHEN (3*d[n-1] - d[n-2])/2 * d[n-1] <= 0 THEN 0.0::DOUBLE WHEN d[n-1]*d[n-2] < 0 AND abs((3*d[n-1] - d[n-2])/2) > 3*abs(d[n-1]) THEN 3*d[n-1] ELSE (3*d[n-1] - d[n-2])/2 END
        WHEN d[i-1]*d[i] <= 0 THEN 0.0::DOUBLE ELSE 2*d[i-1]*d[i]/(d[i-1]+d[i]) END) AS m FROM dd"""),
    "xy": (["segs", "sl"], "SELECT s.traj_id, s.seg, s.n, s.y AS lat, s.m AS mlat, o.y AS lon, o.m AS mlon FROM sl s JOIN slo o ON o.traj_id = s.traj_id AND o.seg = s.seg"),
    "q": (["xy"], "SELECT *, least(CAST(floor(x) AS BIGINT), n - 2) AS i, x - least(floor(x), n - 2) AS u FROM (SELECT xy.*, j, j * (n - 1) / 199.0::DOUBLE AS x FROM xy, range(0, 200) r(j))")}
_ARR.update({f"{n}o": ([f"{d}o" if d != "segs" else d for d in _ARR[n][0]], _ARR[n][1].replace("list(lat ORDER", "list(lon ORDER").replace("FROM arr", "FROM arro").replace("FROM dd", "FROM ddo")) for n in ("arr", "dd", "sl")})
_ARR["xy"] = (["sl", "slo"], _ARR["xy"][1])
_HERMITE = "round({0}[i+1]*(1 + 2*u)*pow(1-u, 2) + m{0}[i+1]*u*pow(1-u, 2) + {0}[i+2]*u*u*(3 - 2*u) - m{0}[i+2]*u*u*(1-u), 7) AS {0}"


@query("T2_resample_pchip", sql(f"""SELECT traj_id, CAST(j AS BIGINT) AS j, {_HERMITE.format("lat")}, {_HERMITE.format("lon")} FROM q""", "q", extra=_ARR))
def t2(d):
    t = resample.resample_curve(views.trajectories(d.points(), 300.0, 3), 200)
    return rounded(t.select("traj_id", F.posexplode("curve").alias("j", "c")).select("traj_id", F.col("j").cast("bigint"), "c.lat", "c.lon"), lat=7, lon=7)


def _user_trips(d):
    return d.points().withColumn("traj_id", F.col("user_id"))


@query("T4_adaptive_resample", sql(f""", z AS (SELECT user_id AS traj_id, t, lat, lon, count(*) OVER (PARTITION BY user_id) AS n, min(t) OVER (PARTITION BY user_id) AS t0 FROM points),
    f AS (SELECT *, {sql_uniform(2, 'atr', 'traj_id')} < 0.5 AND n >= 40 AS binned, 3 + {sql_draw(2, 'bin', 'traj_id')} % 4 AS kk, floor(t0 / 86400) * 86400 AS day0,
       floor(n * CASE WHEN n <= 36 THEN 1.0::DOUBLE WHEN n >= 600 THEN 0.35::DOUBLE ELSE greatest(1 - ln(n - 35) / ln(565.0::DOUBLE) * 0.65::DOUBLE, 0.35::DOUBLE) END) AS want FROM z),
    o AS (SELECT traj_id, CAST(day0 + b * kk AS DOUBLE) AS t, avg(lat) AS lat FROM (SELECT *, floor((t - day0) / kk) AS b FROM f WHERE binned) GROUP BY traj_id, day0, b, kk
      UNION ALL SELECT traj_id, t, lat FROM (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY md5(concat_ws('|', '2', 'keep', traj_id, concat(CAST(CAST(t AS BIGINT) / 1000000000.0::DOUBLE AS VARCHAR), 'E9')))) AS r FROM f WHERE NOT binned) WHERE r <= want)
    SELECT traj_id, t, round(lat, 7) AS lat, coalesce(t - lag(t) OVER (PARTITION BY traj_id ORDER BY t), 0) AS dt FROM o""", "points"))
def t4(d):
    r = resample.adaptive_resample(_user_trips(d), 2, 0.5, 40)
    return r.select("traj_id", "t", F.round("lat", 7).alias("lat"), "dt")


_SEQ = {**_REGION, "rs": (["rid"], "SELECT traj_id, list(region ORDER BY m) AS seq FROM (SELECT traj_id, region, min(t) AS m FROM rid GROUP BY ALL) GROUP BY traj_id"),
        "rl": (["rid"], "SELECT traj_id, list(region ORDER BY t) AS seq FROM rid GROUP BY traj_id")}


def _regions(d):
    r = G.RegionGrid.fit(d.points()).ids(d.fixes(), d.fixes())
    seq = F.transform(F.sort_array(F.collect_list(F.struct("t", "region"))), lambda s: s["region"])
    return r.groupBy("traj_id").agg(seq.alias("seq"))


@query("T5_dedup_sequence", sql("SELECT traj_id, array_to_string(seq, ',') AS seq FROM rs", "rs", extra=_SEQ))
def t5(d):
    return _regions(d).select("traj_id", F.concat_ws(",", F.transform(F.array_distinct("seq"), lambda x: x.cast("string"))).alias("seq"))


@query("T6_pad_or_truncate", sql("""SELECT traj_id, array_to_string(CASE WHEN len(seq) > 5 THEN list_concat(seq[1:4], seq[len(seq):len(seq)]) ELSE list_concat(seq, list_transform(range(0, 5 - len(seq)), lambda i: 0::BIGINT)) END, ',') AS padded,
    least(len(seq), 5) AS n FROM rl""", "rl", extra=_SEQ))
def t6(d):
    seq, mask = resample.pad_or_truncate(F.col("seq"), 5)
    return _regions(d).select("traj_id", F.concat_ws(",", F.transform(seq, lambda x: x.cast("string"))).alias("padded"),
                              F.aggregate(mask, F.lit(0.0), lambda a, x: a + x).cast("bigint").alias("n"))


_U = lambda salt, *k: sql_uniform(8, salt, *k)


@query("T7_augment_region", sql(f""", a1 AS (SELECT traj_id, seq, len(seq) AS n, {_U('region.any', 'traj_id')} AS p, {sql_draw(8, 'region.start', 'traj_id')} AS sd FROM rl),
    b AS (SELECT *, least(5, n - 1) AS w, sd % greatest(n - least(5, n - 1) + 1, 1) AS s FROM a1),
    x AS (SELECT traj_id, p, n, i, seq[i + 1] AS v, CASE WHEN p < 0.5 AND n > 1 AND i >= s AND i < s + w THEN s ELSE i END AS blk, CASE WHEN p < 0.5 AND n > 1 AND i >= s AND i < s + w
         THEN md5(concat_ws('|', '8', 'region.mix', traj_id, CAST(i AS VARCHAR))) ELSE '' END AS h FROM (SELECT *, unnest(range(0, n)) AS i FROM b)),
    y AS (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY blk, h, i) - 1 AS j FROM x),
    z AS (SELECT *, p >= 0.7 OR {_U('region.drop', 'traj_id', 'j')} > 0.2 AS keep FROM y)
    SELECT traj_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY j) AS seq FROM (SELECT *, bool_or(keep) OVER (PARTITION BY traj_id) AS any_kept FROM z) WHERE keep OR NOT any_kept GROUP BY traj_id""", "rl", extra=_SEQ))
def t7(d):
    return _regions(d).select("traj_id", F.concat_ws(",", F.transform(resample.augment_region(F.col("seq"), F.col("traj_id"), 8), lambda x: x.cast("string"))).alias("seq"))


@query("T7_augment_road", sql(f""", a1 AS (SELECT traj_id, seq, len(seq) AS n, {_U('road.any', 'traj_id')} < 0.7 AS act, {sql_draw(8, 'road.kind', 'traj_id')} % 5 AS kind,
      {sql_draw(8, 'road.start', 'traj_id')} AS sd, {sql_draw(8, 'road.size', 'traj_id')} AS zd FROM rl),
    b AS (SELECT *, sd % greatest(n - 1, 1) AS s FROM a1), c AS (SELECT *, 2 + zd % greatest(n - s - 1, 1) AS z FROM b),
    x AS (SELECT traj_id, kind, n, s, z, act, i, seq[i + 1] AS v, {_U('road.drop', 'traj_id', 'i')} AS u, md5(concat_ws('|', '8', 'road.local', traj_id, CAST(i AS VARCHAR))) AS h FROM (SELECT *, unnest(range(0, n)) AS i FROM c)),
    y AS (SELECT *, CASE WHEN NOT act THEN true WHEN kind = 0 THEN n <= 3 OR (i >= s AND i < s + z) WHEN kind = 3 THEN n <= 3 OR u > 0.1 ELSE true END AS keep,
       CASE WHEN act AND kind = 1 THEN -i WHEN act AND kind = 4 AND n > 3 AND i < (n // 3) * 3 THEN i // 3 ELSE i END AS o1, CASE WHEN act AND kind = 4 AND n > 3 AND i < (n // 3) * 3 THEN h ELSE '' END AS o2 FROM x)
    SELECT t.traj_id, coalesce(string_agg(CAST(v AS VARCHAR), ',' ORDER BY o1, o2, i), '') AS seq FROM rl t LEFT JOIN y ON y.traj_id = t.traj_id AND keep GROUP BY t.traj_id""", "rl", extra=_SEQ))
def t7b(d):
    return _regions(d).select("traj_id", F.concat_ws(",", F.transform(resample.augment_road(F.col("seq"), F.col("traj_id"), 999, 8), lambda x: x.cast("string"))).alias("seq"))
