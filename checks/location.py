"""Next location and continuous targets (B4-B7, B19, L, C, H2-H6)."""
from __future__ import annotations

from pyspark.sql import functions as F

from wayspark.operators import continuous as C
from wayspark.operators import features, location as L, probes, scores
from wayspark.plans import continuous as continuous_plan
from wayspark.plans import next_location as location_plan

from .common import longs, rounded
from .inputs import Inputs, hav, sql

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


def _of(d, split):
    return d.visits().filter(F.col("split") == split)


_KY = "(0.017453292519943295::DOUBLE * 6371008.8::DOUBLE)"
_CLAT = f"((g.y0 + (({{c}}) // CAST(g.nx AS BIGINT) + 0.5::DOUBLE) * 500) / {_KY} + g.lat0)"
_CLON = "((g.x0 + ((({c}) % CAST(g.nx AS BIGINT)) + 0.5::DOUBLE) * 500) / g.kx + g.lon0)"

_LOC = {
    "cells": (["grid"], "SELECT unnest(range(0, CAST(nx * ny AS BIGINT))) AS cell FROM grid"),
    "tv": (["tgt"], "SELECT * FROM tgt WHERE split = 'test'"),
    "trv": (["tgt"], "SELECT last_cell, cell FROM tgt WHERE split = 'train'"),
    "pop": (["cells", "trv"], """SELECT cell, n, (n + 0.1::DOUBLE) / sum(n + 0.1::DOUBLE) OVER () AS pop FROM (SELECT c.cell, count(v.cell) AS n FROM cells c
         LEFT JOIN (SELECT last_cell AS cell FROM trv UNION ALL SELECT cell FROM trv) v ON v.cell = c.cell GROUP BY c.cell)"""),
    "rowtot": (["trv"], "SELECT last_cell, count(*) AS tot FROM trv GROUP BY last_cell"),
    "rowm": (["trv"], "SELECT last_cell, cell, count(*) AS m FROM trv GROUP BY last_cell, cell"),
    "dense": (["tv", "pop", "ctx", "rowtot", "rowm"], """SELECT tv.sample_id, 'global_popular' AS model, p.cell, p.pop AS p FROM tv, pop p
        UNION ALL SELECT tv.sample_id, 'user_frequent', p.cell, (coalesce(x.n, 0) + 0.001::DOUBLE * p.pop) / (3 + 0.001::DOUBLE) FROM tv CROSS JOIN pop p
           LEFT JOIN (SELECT sample_id, cell, count(*) AS n FROM ctx GROUP BY ALL) x ON x.sample_id = tv.sample_id AND x.cell = p.cell
        UNION ALL SELECT tv.sample_id, 'markov1', p.cell, CASE WHEN r.tot IS NULL THEN p.pop ELSE (coalesce(m.m, 0) + 0.01::DOUBLE * p.pop) / (r.tot + 0.01::DOUBLE) END FROM tv CROSS JOIN pop p
           LEFT JOIN rowtot r ON r.last_cell = tv.last_cell LEFT JOIN rowm m ON m.last_cell = tv.last_cell AND m.cell = p.cell
        UNION ALL SELECT tv.sample_id, 'recency', c.cell, coalesce(s.p, 0) FROM tv CROSS JOIN cells c LEFT JOIN
           (SELECT sample_id, cell, sum(w) / 2.46::DOUBLE AS p FROM (SELECT sample_id, cell, pow(0.6::DOUBLE, 3 - k) + CASE WHEN k = 1 THEN 0.5 ELSE 0 END AS w FROM ctx) GROUP BY ALL) s
           ON s.sample_id = tv.sample_id AND s.cell = c.cell"""),
    "rk": (["dense", "tv"], """SELECT d.sample_id, d.model, tv.cell, tv.lat, tv.lon, t.p, count(*) FILTER (WHERE d.p >= t.p) AS rank, arg_max(d.cell, (d.p, -d.cell)) AS top, count(*) AS n_cells
        FROM dense d JOIN tv ON tv.sample_id = d.sample_id JOIN dense t ON t.sample_id = d.sample_id AND t.model = d.model AND t.cell = tv.cell GROUP BY ALL"""),
    "lm": (["rk", "grid"], f"""SELECT *, -ln((1 - 1e-6::DOUBLE) * p + 1e-6::DOUBLE / n_cells) AS nll, {hav(_CLAT.format(c='top'), _CLON.format(c='top'), 'lat', 'lon')} AS d FROM rk, grid g"""),
    "ls": (["lm"], """SELECT sample_id, model, unnest([{'metric': 'acc@1', 'value': (rank <= 1)::INT::DOUBLE}, {'metric': 'acc@5', 'value': (rank <= 5)::INT::DOUBLE}, {'metric': 'acc@10', 'value': (rank <= 10)::INT::DOUBLE},
        {'metric': 'acc@20', 'value': (rank <= 20)::INT::DOUBLE}, {'metric': 'mrr@20', 'value': CASE WHEN rank <= 20 THEN 1.0::DOUBLE / rank ELSE 0 END}, {'metric': 'loc_nll', 'value': nll}, {'metric': 'dist_err_m', 'value': d},
        {'metric': 'median_dist_err_m', 'value': d}, {'metric': 'acc_1km', 'value': (d <= 1000)::INT::DOUBLE}]) AS m FROM lm"""),
}


def _baselines(d):
    return L.LocationBaselines(_of(d, "train"), d.grid().n_cells)


for _id, _name in (("B4_global_popular", "global_popular"), ("B5_user_frequent", "user_frequent"), ("B6_markov1", "markov1")):
    query(_id, sql(f"SELECT sample_id, rank, round(p, 9) AS p, top FROM rk WHERE model = '{_name}'", "rk", extra=_LOC))(
        lambda d, n=_name: longs(rounded(getattr(_baselines(d), n)(_of(d, "test")).select("sample_id", "rank", "p", "top"), p=9), "rank", "top"))


def _recency(d):
    s = L.recency_scores(_of(d, "test"))
    total = s.groupBy("sample_id").agg(F.sum("score").alias("z"))
    return L.normalise(s.join(total, "sample_id").withColumn("score", F.col("score") / F.col("z")))


@query("B19_recency_scores", sql("SELECT sample_id, cell, round(p, 9) AS p FROM dense WHERE model = 'recency' AND p > 0", "dense", extra=_LOC))
def b19(d):
    return rounded(_recency(d).select("sample_id", "cell", "p"), p=9)


@query("L_rank", sql("""SELECT sample_id, m.metric, round(m.value, 6) AS value FROM ls WHERE model = 'recency' AND m.metric IN ('acc@1', 'acc@5', 'acc@10', 'acc@20', 'mrr@20')""", "ls", extra=_LOC))
def l_rank(d):
    m = L.location_metrics(L.rank_scores(_recency(d), _of(d, "test"), d.grid().n_cells), d.grid())
    return rounded(m.filter("metric in ('acc@1', 'acc@5', 'acc@10', 'acc@20', 'mrr@20')"), value=6)


@query("L_nll", sql("SELECT sample_id, round(nll, 6) AS value FROM lm WHERE model = 'recency'", "lm", extra=_LOC))
def l_nll(d):
    m = L.location_metrics(L.rank_scores(_recency(d), _of(d, "test"), d.grid().n_cells), d.grid())
    return rounded(m.filter("metric = 'loc_nll'").select("sample_id", "value"), value=6)


@query("L_dist", sql(f"""SELECT t.sample_id, c.cell = t.cell AS hit, round({hav('c.lat', 'c.lon', 't.lat', 't.lon')}, 4) AS dist_err_m FROM tv t JOIN ctx c ON c.sample_id = t.sample_id AND c.k = 2""", "tv", "ctx", extra=_LOC))
def l_dist(d):
    v, g = _of(d, "test"), d.grid()
    places = L.next_to_last(v)
    m = L.location_metrics(L.rank_scores(L.point_scores(places, g), v, g.n_cells), g, places, point_only=True)
    wide = m.groupBy("sample_id").pivot("metric", ["acc@1", "dist_err_m"]).agg(F.first("value"))
    return rounded(wide.select("sample_id", (F.col("`acc@1`") == 1.0).alias("hit"), "dist_err_m"), dist_err_m=4)


@query("L_map_tokens", sql("""SELECT sample_id, cell, round(sum(w) / 2.46::DOUBLE, 9) AS p FROM (SELECT sample_id, cell, pow(0.6::DOUBLE, 3 - k) + CASE WHEN k = 1 THEN 0.5 ELSE 0 END AS w FROM ctx WHERE split = 'test') GROUP BY ALL""", "ctx"))
def l_map(d):
    c = _of(d, "test").select("sample_id", F.posexplode("ctx").alias("k", "v"))
    name = F.concat_ws("/", "sample_id", F.col("k").cast("string"))
    tokens = c.select(name.alias("token"), F.col("v.lat").alias("lat"), F.col("v.lon").alias("lon"))
    weight = F.pow(F.lit(0.6), 2 - F.col("k")) + F.when(F.col("k") == 0, 0.5).otherwise(0.0)
    cells, _ = L.tokens_to_cells(c.select("sample_id", name.alias("token"), (weight / 2.46).alias("p")), tokens, d.grid())
    return rounded(cells, p=9)


_CAND = {**_LOC,
    "cand": (["trv"], "SELECT cell, n, row_number() OVER (ORDER BY n DESC, cell) - 1 AS label FROM (SELECT cell, count(*) AS n FROM trv GROUP BY cell ORDER BY n DESC, cell LIMIT 5)"),
    # the recency model restricted to the candidates and renormalised
    "cp": (["dense", "cand"], """SELECT sample_id, cell, p / sum(p) OVER (PARTITION BY sample_id) AS p FROM (SELECT d.sample_id, d.cell, d.p + 0.01::DOUBLE AS p FROM dense d JOIN cand c ON c.cell = d.cell WHERE model = 'recency')"""),
    "cr": (["cp", "tv", "trv"], """SELECT t.sample_id, t.cell, o.p IS NOT NULL AS inside, count(*) FILTER (WHERE c.p >= o.p) AS rank, o.p,
        (SELECT count(*) FROM trv WHERE trv.cell = t.cell)::DOUBLE / (SELECT count(*) FROM trv) AS share
        FROM tv t JOIN cp c ON c.sample_id = t.sample_id LEFT JOIN cp o ON o.sample_id = t.sample_id AND o.cell = t.cell GROUP BY t.sample_id, t.cell, o.p"""),
}


@query("H3_candidate_cells", sql("SELECT cell, n AS cnt, label FROM cand", "cand", extra=_CAND))
def h3(d):
    return longs(L.candidate_cells(_of(d, "train"), 5), "label")


@query("L_cand", sql("""SELECT sample_id, CASE WHEN inside AND rank <= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS acc1, CASE WHEN inside AND rank <= 20 THEN round(1.0::DOUBLE / rank, 6) ELSE 0.0::DOUBLE END AS mrr20,
    round(-ln(least(greatest(CASE WHEN inside THEN (1 - 0.001::DOUBLE) * p ELSE 0.001::DOUBLE * share END, 1e-9::DOUBLE), 1.0::DOUBLE)), 6) AS loc_nll, inside::INT::DOUBLE AS probe_coverage FROM cr""", "cr", extra=_CAND))
def l_cand(d):
    train, test, g = _of(d, "train"), _of(d, "test"), d.grid()
    cand = L.candidate_cells(train, 5)
    every = test.select("sample_id").join(F.broadcast(cand.select("cell")), how="inner")      # five candidates per sample
    p = every.join(_recency(d).select("sample_id", "cell", "p"), ["sample_id", "cell"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)) + 0.01)
    z = p.groupBy("sample_id").agg(F.sum("p").alias("z"))
    probs = p.join(z, "sample_id").select("sample_id", "cell", (F.col("p") / F.col("z")).alias("p"))
    m = L.candidate_metrics(probs, train, test, cand, g)
    w = m.groupBy("sample_id").pivot("metric", ["acc@1", "mrr@20", "loc_nll", "probe_coverage"]).agg(F.first("value"))
    return rounded(w.select("sample_id", F.col("`acc@1`").alias("acc1"), F.col("`mrr@20`").alias("mrr20"), "loc_nll", "probe_coverage"), mrr20=6, loc_nll=6)


@query("H2_next_location_eval", sql("""SELECT model, metric, round(value, 5) AS value, n FROM (SELECT CASE WHEN model = 'recency' THEN model ELSE concat('baseline:', model) END AS model, m.metric AS metric,
    CASE WHEN m.metric = 'median_dist_err_m' THEN quantile_cont(m.value, 0.5) ELSE avg(m.value) END AS value, count(*) AS n FROM ls GROUP BY model, m.metric)""", "ls", extra=_LOC))
def h2(d):
    r = location_plan.next_location_eval(_of(d, "train"), _of(d, "test"), d.grid(), {"recency": _recency(d)})
    return rounded(r.select("model", "metric", "value", "n"), value=5)


def _embedded(d):
    """Context embedding of every visit sample: its visit tokens in order."""
    v = d.visits()
    g = d.grid()
    t = features.visit_tokens(v, g.lat0, g.lon0)
    names = [c for c in t.columns if c not in ("sample_id", "k")]
    vec = t.groupBy("sample_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", F.array(*names).alias("a")))), lambda s: s["a"])).alias("embedding"))
    return v.join(vec, "sample_id")


@query("H4_location_probe")
def h4(d):
    e = _embedded(d)
    train, test = e.filter("split = 'train'"), e.filter("split = 'test'")
    probs, cand = probes.location_probe(train, test, 1000)
    m = L.candidate_metrics(probs, train, test, cand, d.grid())
    return scores.aggregate_values(m.withColumn("model", F.lit("probe")), ["model"])


@query("H2_probe_eval")
def h2_probe(d):
    e = _embedded(d)
    return location_plan.probe_eval(e.filter("split = 'train'"), e.filter("split = 'test'"), d.grid(), 1000).select("task", "protocol", "model", "metric", "value", "n", "skill")


# ------------------------------------------------------------------ continuous
def _y(d, split, target="duration"):
    return C.target_minutes(_of(d, split), target)


def _sql_erf(x):
    return (f"(CASE WHEN abs({x}) >= 6 THEN sign({x})::DOUBLE WHEN {x} = 0 THEN 0.0::DOUBLE ELSE sign({x}) * 2 / sqrt(pi()) * exp(-({x}) * ({x})) * list_sum(list_transform(range(0, 140), "
            f"lambda n: exp((2 * n + 1) * ln(abs({x})) + n * ln(4.0::DOUBLE) + lgamma(n + 1.0::DOUBLE) - lgamma(2 * n + 2.0::DOUBLE)))) END)")


def _sql_cdf(z):
    return f"(0.5::DOUBLE * (1 + {_sql_erf('((' + z + ') / sqrt(2.0::DOUBLE))')}))"


_CONT = {
    "yt": (["tgt"], "SELECT sample_id, split, duration_s / 60.0::DOUBLE AS y FROM tgt WHERE duration_s > 0"),
    "up": (["yt"], "SELECT quantile_cont(y, 0.99) AS upper FROM yt WHERE split = 'train'"),
    "comp": (["ctx", "yt"], """SELECT c.sample_id, c.k, CASE c.k WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END AS w, ln((c.t_leave - c.t_arrive) / 60.0::DOUBLE) AS mu, 0.3::DOUBLE + 0.1::DOUBLE * c.k AS sd,
        (c.t_leave - c.t_arrive) / 60.0::DOUBLE AS lmu, 10.0::DOUBLE * c.k AS lsd, y.y FROM ctx c JOIN yt y ON y.sample_id = c.sample_id WHERE y.split = 'test'"""),
    "logm": (["comp"], f"""SELECT sample_id, any_value(y) AS y, sum(w * {_sql_cdf('(ln(y) - mu) / sd')}) AS pit,
        -ln(sum(w * exp(-0.5::DOUBLE * pow((ln(y) - mu) / sd, 2)) / sd / sqrt(2 * pi()))) + ln(any_value(y)) AS nll,
        sum(w * (y * (2 * {_sql_cdf('(ln(y) - mu) / sd')} - 1) + exp(mu + sd * sd / 2) * (1 - 2 * {_sql_cdf('(ln(y) - mu - sd * sd) / sd')}))) AS t1, sum(w * exp(mu + 0.5::DOUBLE * sd * sd)) AS mean FROM comp GROUP BY sample_id"""),
    "logp": (["comp"], f"""SELECT a.sample_id, sum(a.w * b.w * (2 * (exp(a.mu + a.sd*a.sd/2) * {_sql_cdf('(a.mu + a.sd*a.sd - b.mu) / sqrt(a.sd*a.sd + b.sd*b.sd)')} + exp(b.mu + b.sd*b.sd/2) * {_sql_cdf('(b.mu + b.sd*b.sd - a.mu) / sqrt(a.sd*a.sd + b.sd*b.sd)')})
        - exp(a.mu + a.sd*a.sd/2) - exp(b.mu + b.sd*b.sd/2))) AS t2 FROM comp a JOIN comp b ON a.sample_id = b.sample_id GROUP BY a.sample_id"""),
    "linm": (["comp"], f"""SELECT sample_id, sum(w * {_sql_cdf('(y - lmu) / lsd')}) AS pit, -ln(sum(w * exp(-0.5::DOUBLE * pow((y - lmu) / lsd, 2)) / lsd / sqrt(2 * pi())) + 0.0) AS nll,
        sum(w * (2 * lsd * exp(-0.5::DOUBLE * pow((y - lmu) / lsd, 2)) / sqrt(2 * pi()) + (y - lmu) * (2 * {_sql_cdf('(y - lmu) / lsd')} - 1))) AS t1 FROM comp GROUP BY sample_id"""),
    "linp": (["comp"], f"""SELECT sample_id, sum(w * (2 * s * exp(-0.5::DOUBLE * pow(m / s, 2)) / sqrt(2 * pi()) + m * (2 * {_sql_cdf('m / s')} - 1))) AS t2 FROM
        (SELECT a.sample_id, a.w * b.w AS w, a.lmu - b.lmu AS m, sqrt(a.lsd*a.lsd + b.lsd*b.lsd) AS s FROM comp a JOIN comp b ON a.sample_id = b.sample_id) GROUP BY sample_id"""),
}


def _mixture_rows(d, space):
    rows = _y(d, "test")
    arr = lambda f: F.transform("ctx", f)
    mu = arr(lambda v: F.log((v["t_leave"] - v["t_arrive"]) / 60.0)) if space == "log" else arr(lambda v: (v["t_leave"] - v["t_arrive"]) / 60.0)
    sd = F.array(F.lit(0.4), F.lit(0.5), F.lit(0.6)) if space == "log" else F.array(F.lit(10.0), F.lit(20.0), F.lit(30.0))
    return rows.withColumn("mixture", F.struct(F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2)).alias("w"), mu.alias("mu"), sd.alias("sd"), F.lit(space).alias("space")))


@query("C_point", sql("""SELECT sample_id, round(abs(30 - y), 6) AS mae_min, round(pow(30 - y, 2), 4) AS rmse_min, round(abs(30 - y) / greatest(y, 1e-9::DOUBLE), 6) AS mape FROM yt WHERE split = 'test'""", "yt", extra=_CONT))
def c_pt(d):
    m = C.point_metrics(_y(d, "test").withColumn("point", F.lit(30.0)), ["sample_id"])
    w = m.groupBy("sample_id").pivot("metric", ["mae_min", "rmse_min", "mape"]).agg(F.first("value"))
    return rounded(w, mae_min=6, rmse_min=4, mape=6)


@query("C_validity_travel", sql("""SELECT sample_id, round(travel_s / 60.0::DOUBLE, 6) AS y FROM tgt WHERE travel_s > 0 AND travel_s <= 240 * 60""", "tgt"))
def c_valid(d):
    return rounded(C.target_minutes(d.visits(), "travel_time").select("sample_id", "y"), y=6)


@query("C_mix_log", sql("""SELECT m.sample_id, round(pit, 6) AS pit, round(nll, 5) AS nll, round(mean, 4) AS mean FROM logm m""", "logm", extra=_CONT))
def c_mix(d):
    from wayspark.functions.normal import mixture
    s = C.mixture_scores(_mixture_rows(d, "log"))
    return rounded(s.select("sample_id", "pit", "nll", mixture("mean", F.col("mixture")).alias("mean")), pit=6, nll=5, mean=4)


@query("C_mix_median", sql(f"""SELECT l.sample_id, true AS at_half FROM logm l""", "logm", extra=_CONT))
def c_median(d):
    from wayspark.functions.normal import mixture
    s = C.mixture_scores(_mixture_rows(d, "log"))
    return s.select("sample_id", (F.abs(mixture("cdf", F.col("mixture"), F.col("point")) - 0.5) < 1e-9).alias("at_half"))


@query("C_crps_log", sql("SELECT m.sample_id, round(t1 - 0.5::DOUBLE * t2, 4) AS crps_min FROM logm m JOIN logp p ON p.sample_id = m.sample_id", "logm", "logp", extra=_CONT))
def c_crps(d):
    return rounded(C.mixture_scores(_mixture_rows(d, "log")).select("sample_id", "crps_min"), crps_min=4)


@query("C_crps_linear", sql("SELECT m.sample_id, round(pit, 6) AS pit, round(t1 - 0.5::DOUBLE * t2, 4) AS crps_min FROM linm m JOIN linp p ON p.sample_id = m.sample_id", "linm", "linp", extra=_CONT))
def c_crps_lin(d):
    return rounded(C.mixture_scores(_mixture_rows(d, "linear")).select("sample_id", "pit", "crps_min"), pit=6, crps_min=4)


@query("C_crps_samples", sql("""SELECT sample_id, round(avg(abs(x - y)) - sum(x * (2 * r - n - 1)) / (any_value(n) * any_value(n)), 4) AS crps_min FROM
    (SELECT sample_id, lmu AS x, y, row_number() OVER (PARTITION BY sample_id ORDER BY lmu) AS r, count(*) OVER (PARTITION BY sample_id) AS n FROM comp) GROUP BY sample_id""", "comp", extra=_CONT))
def c_samples(d):
    rows = _y(d, "test").withColumn("samples", F.transform("ctx", lambda v: (v["t_leave"] - v["t_arrive"]) / 60.0))
    return rounded(C.sample_metrics(rows, ["sample_id"]).filter("metric = 'crps_min'").select("sample_id", F.col("value").alias("crps_min")), crps_min=4)


def _within_sql(t):
    hi, lo = f"least(yy + {t}, upper)", f"greatest(yy - {t}, 0.0::DOUBLE)"
    c = lambda e: _sql_cdf(f"(ln(greatest({e}, 1e-12::DOUBLE)) - mu) / sd")
    return f"round(least(greatest(sum(w * {c(hi)}) - sum(w * {c(lo)}), 0) / (sum(w * {c('upper')}) - sum(w * {c('0.0::DOUBLE')})), 1.0::DOUBLE), 6) AS p{t}"


@query("C_pin_mixture", sql(f"""SELECT sample_id, {_within_sql(5)}, {_within_sql(20)} FROM (SELECT *, least(greatest(y, 0.0::DOUBLE), upper) AS yy FROM comp, up) GROUP BY sample_id""", "comp", "up", extra=_CONT))
def c_pin(d):
    m = C.mixture_metrics(_mixture_rows(d, "log"), ["sample_id"], C.support_max(_y(d, "train")))
    w = m.groupBy("sample_id").pivot("metric", ["p_within_5min", "p_within_20min"]).agg(F.first("value"))
    return rounded(w.select("sample_id", F.col("p_within_5min").alias("p5"), F.col("p_within_20min").alias("p20")), p5=6, p20=6)


@query("C_pin_point", sql("""SELECT sample_id, (abs(least(400.0::DOUBLE, upper) - least(y, upper)) <= 20)::INT::DOUBLE AS p20 FROM yt, up WHERE split = 'test'""", "yt", "up", extra=_CONT))
def c_pin_point(d):
    m = C.point_within(_y(d, "test").withColumn("point", F.lit(400.0)), ["sample_id"], C.support_max(_y(d, "train")))
    return m.filter("metric = 'p_within_20min'").select("sample_id", F.col("value").alias("p20"))


@query("C_pit", sql("""SELECT round(avg((pit BETWEEN 0.1 AND 0.9)::INT::DOUBLE), 6) AS coverage80, round(max(greatest(r / n - pit, pit - (r - 1) / n)), 6) AS pit_ks FROM
    (SELECT pit, (row_number() OVER (ORDER BY pit))::DOUBLE AS r, (count(*) OVER ())::DOUBLE AS n FROM logm)""", "logm", extra=_CONT))
def c_pit(d):
    s = C.mixture_scores(_mixture_rows(d, "log"))
    one = F.lit(1).alias("one")
    cover = s.agg(F.avg(C.coverage80(F.col("pit"))).alias("coverage80")).select("*", one)
    return rounded(cover.join(C.pit_ks(s, []).select("*", one), "one").drop("one"), coverage80=6, pit_ks=6)


@query("C_pseudo_nll", sql("""SELECT sample_id, round(0.5::DOUBLE * ln(2 * pi()) + ln(s) + 0.5::DOUBLE * pow((y - 300) / s, 2), 6) AS value FROM yt, (SELECT stddev_pop(y - 300) AS s FROM yt WHERE split = 'val') WHERE split = 'test'""", "yt", extra=_CONT))
def c_pnll(d):
    point = lambda split: _y(d, split).withColumn("point", F.lit(300.0))
    m = C.pseudo_nll(point("test"), ["sample_id"], C.residual_sigma(point("val")))
    return rounded(m.select("sample_id", "value"), value=6)


@query("B19_own_context_mixture", sql("""SELECT sample_id, round(avg(ln(greatest(t_leave - t_arrive, 60))), 8) AS mu, round(stddev_pop(ln(greatest(t_leave - t_arrive, 60))) + 0.3, 8) AS sd FROM ctx GROUP BY sample_id""", "ctx"))
def b19b(d):
    m = C.own_context_mixture(d.visits(), "duration")
    return m.select("sample_id", F.round(F.col("mixture.mu")[0], 8).alias("mu"), F.round(F.col("mixture.sd")[0], 8).alias("sd"))


@query("F12_revealed_features", sql("""SELECT sample_id, round(lat, 8) AS lat, round(sin(2 * pi() * (t_arrive % 86400) / 86400), 8) AS s, round(cos(2 * pi() * (t_arrive % 86400) / 86400), 8) AS c FROM tgt""", "tgt"))
def f12(d):
    r = C.revealed_features(d.visits(), ("location", "arrival"))
    v = lambda i: F.round(F.col("revealed")[i], 8)
    return r.select("sample_id", v(0).alias("lat"), v(2).alias("s"), v(3).alias("c"))


@query("F7_visit_tokens", sql("""SELECT c.sample_id, CAST(c.k - 1 AS BIGINT) AS k, round(least(greatest((c.lon - g.lon0) * g.kx / 10000, -50.0::DOUBLE), 50.0::DOUBLE), 8) AS x,
      round(sin(2 * pi() * (c.t_arrive % 86400) / 86400), 8) AS in_sin, round(cos(2 * pi() * (c.t_leave % 86400) / 86400), 8) AS out_cos,
      round(ln(1 + (c.t_leave - c.t_arrive) / 3600), 8) AS log_stay, round(ln(1 + greatest(c.t_arrive - coalesce(p.t_leave, c.t_leave), 0) / 3600), 8) AS log_travel,
      round(((floor(c.t_arrive / 86400) + 3) % 7) / 6.0::DOUBLE, 8) AS weekday
    FROM ctx c JOIN grid g ON true LEFT JOIN ctx p ON p.sample_id = c.sample_id AND p.k = c.k - 1""", "ctx", "grid"))
def f7(d):
    g = d.grid()
    t = features.visit_tokens(d.visits(), g.lat0, g.lon0).select("sample_id", "k", "x", "in_sin", "out_cos", "log_stay", "log_travel", "weekday")
    return rounded(t, x=8, in_sin=8, out_cos=8, log_stay=8, log_travel=8, weekday=8)


@query("B7_train_marginal")
def b7(d):
    median, mix = C.train_marginal(_y(d, "train"))
    rows = C.constant_mixture(_y(d, "test").withColumn("point", F.lit(median)), mix)
    return C.mixture_metrics(rows, ["sample_id"], C.support_max(_y(d, "train")))


@query("B7_train_median", sql("SELECT round(quantile_cont(y, 0.5), 6) AS median_min FROM yt WHERE split = 'train'", "yt", extra=_CONT))
def b7b(d):
    from wayspark.functions.ordered import exact_percentiles
    return rounded(exact_percentiles(_y(d, "train"), [], "y", {"median_min": 0.5}), median_min=6)


@query("H5_continuous_eval")
def h5(d):
    return continuous_plan.continuous_eval(_of(d, "train"), _of(d, "val"), _of(d, "test"), "duration",
                                           {"own_context": lambda v: C.own_context_mixture(v, "duration")})


@query("H6_continuous_probe")
def h6(d):
    e = _embedded(d)
    part = lambda s: C.target_minutes(e.filter(F.col("split") == s), "duration")
    p = probes.continuous_probe(part("train"), part("test"), part("val"), "embedding")
    return C.mixture_metrics(p, ["sample_id"], C.support_max(part("train")))
