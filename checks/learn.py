"""Features, classifiers, detection, identity, retrieval and injected anomalies (F, B8-B14, K, U, A, Q, H7-H17)."""
from __future__ import annotations

from pyspark.sql import functions as F

from wayspark.functions.draws import uniform
from wayspark.operators import classify, detection, features, grid as G, inject, retrieval, scores, views
from wayspark.plans import anomaly, identity, modes, retrieval as retrieval_plan

from .common import longs, rounded
from .core import _REGION
from .inputs import LENGTH, Inputs, hav, sql, sql_draw, sql_hex, sql_normal, sql_uniform

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


def _split(d, s):
    return d.windows().filter(F.col("split") == s)


def _kin(source, extra=""):
    """SQL of the eleven features over a long window table."""
    g = f"window_id{extra}"
    return f"""SELECT {g}, avg(v) AS v_mean, quantile_cont(v, 0.5) AS v_p50, quantile_cont(v, 0.85) AS v_p85, quantile_cont(v, 0.95) AS v_p95, stddev_pop(v) AS v_std, avg(ac) AS a_mean,
        quantile_cont(ac, 0.9) AS a_p90, avg(abs(atan2(sin(dh), cos(dh)))) AS turn_mean, avg(CASE WHEN v < 0.5 THEN 1.0::DOUBLE WHEN v IS NOT NULL THEN 0.0::DOUBLE END) AS share_slow,
        sum(d) AS path_m, max(t) - min(t) AS duration_s FROM
      (SELECT *, abs((v - lag(v) OVER w) / dtt) AS ac, hd - lag(hd) OVER w AS dh FROM
        (SELECT *, d / dtt AS v, atan2(y - lag(y) OVER w, x - lag(x) OVER w) AS hd FROM
          (SELECT *, greatest(t - lag(t) OVER w, 1.0::DOUBLE) AS dtt, radians(lat) AS y, radians(lon) * cos(avg(radians(lat)) OVER (PARTITION BY {g})) AS x,
             {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS d FROM {source} WINDOW w AS (PARTITION BY {g} ORDER BY pos))
         WINDOW w AS (PARTITION BY {g} ORDER BY pos)) WINDOW w AS (PARTITION BY {g} ORDER BY pos)) GROUP BY {g}"""


_F = {"kin": (["win"], _kin("win")), "lab": (["win"], "SELECT DISTINCT window_id, split, mode, user_id FROM win")}


@query("F5_handcrafted_features", sql("SELECT window_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in features.KINEMATIC) + " FROM kin", "kin", extra=_F))
def f5(d):
    return rounded(features.kinematic_features(d.windows()), **{c: 6 for c in features.KINEMATIC})


@query("F1_F4_step_lengths", sql(f"""SELECT window_id, pos, round({hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')}, 5) AS step_m FROM win WINDOW w AS (PARTITION BY window_id ORDER BY pos)""", "win"))
def f4(d):
    return rounded(features.window_steps(d.windows()).select("window_id", "pos", "step_m"), step_m=5)


@query("F2_local_projection", sql("""SELECT event_id, round((lon - 12.5::DOUBLE) * 0.017453292519943295::DOUBLE * 6371008.8::DOUBLE * cos(radians(55.6::DOUBLE)), 4) AS x, round((lat - 55.6::DOUBLE) * 0.017453292519943295::DOUBLE * 6371008.8::DOUBLE, 4) AS y,
    round(lat, 8) AS lat_back, round(lon, 8) AS lon_back FROM fixes""", "fixes"))
def f2(d):
    from wayspark.functions.geo import to_latlon, to_xy
    p = d.fixes()
    x, y = to_xy(F.col("lat"), F.col("lon"), 55.6, 12.5)
    lat, lon = to_latlon(x, y, 55.6, 12.5)
    return p.select("event_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), F.round(lat, 8).alias("lat_back"), F.round(lon, 8).alias("lon_back"))


@query("F3_radius_of_gyration", sql(f"""SELECT traj_id, round(sqrt(avg(pow({hav('lat', 'lon', 'mlat', 'mlon')}, 2))), 4) AS rg_m FROM (SELECT *, avg(lat) OVER (PARTITION BY traj_id) AS mlat, avg(lon) OVER (PARTITION BY traj_id) AS mlon FROM points) GROUP BY traj_id""", "points"))
def f3(d):
    return rounded(features.radius_of_gyration(d.points(), ["traj_id"]), rg_m=4)


@query("F3_radius_of_gyration_weighted", sql(f"""SELECT user_id, round(sqrt(sum(w * pow({hav('lat', 'lon', 'mlat', 'mlon')}, 2)) / sum(w)), 4) AS rg_m FROM
   (SELECT *, sum(w * lat) OVER u / sum(w) OVER u AS mlat, sum(w * lon) OVER u / sum(w) OVER u AS mlon FROM (SELECT *, t_leave - t_arrive AS w FROM stays) WINDOW u AS (PARTITION BY user_id)) GROUP BY user_id""", "stays"))
def f3w(d):
    s = d.stays().withColumn("w", F.col("t_leave") - F.col("t_arrive"))
    return rounded(features.radius_of_gyration(s, ["user_id"], "w"), rg_m=4)


_HID = "CASE WHEN pos IN (2, 3, 6) THEN true ELSE false END"


@query("F6_F8_point_tokens", sql(f""", h AS (SELECT *, pos IN (2, 3, 6) AS hidden, first_value(lat) OVER w AS lat0, first_value(lon) OVER w AS lon0, coalesce(t - lag(t) OVER w, 0) AS dt FROM win WINDOW w AS (PARTITION BY window_id ORDER BY pos)),
    x AS (SELECT *, CASE WHEN hidden THEN 0 ELSE (lon - lon0) * 0.017453292519943295::DOUBLE * 6371008.8::DOUBLE * cos(radians(lat0)) / 1000 END AS x, CASE WHEN hidden THEN 0 ELSE (lat - lat0) * 0.017453292519943295::DOUBLE * 6371008.8::DOUBLE / 1000 END AS y FROM h),
    z AS (SELECT *, coalesce(x - lag(x) OVER w, 0) * 1000 AS dx, coalesce(y - lag(y) OVER w, 0) * 1000 AS dy, NOT hidden AND NOT coalesce(lag(hidden) OVER w, true) AS known FROM x WINDOW w AS (PARTITION BY window_id ORDER BY pos))
    SELECT window_id, pos, round(x, 6) AS dx_km, round(y, 6) AS dy_km, round(ln(1 + dt) / 5, 6) AS log_dt, round(CASE WHEN known THEN least(sqrt(dx*dx + dy*dy) / greatest(dt, 1) / 10, 10) ELSE 0 END, 6) AS speed,
      round(CASE WHEN known THEN sin(atan2(dy, dx)) ELSE 0 END, 6) AS head_sin, round(CASE WHEN known THEN cos(atan2(dy, dx)) ELSE 0 END, 6) AS head_cos, round(sin(2 * pi() * (t % 86400) / 86400), 6) AS tod_sin,
      round(cos(2 * pi() * (t % 86400) / 86400), 6) AS tod_cos, round(((floor(t / 86400) + 3) % 7) / 6.0::DOUBLE, 6) AS weekday FROM z""", "win"))
def f6(d):
    t = features.point_tokens(d.windows().withColumn("hidden", F.col("pos").isin(2, 3, 6)))
    return rounded(t, **{c: 6 for c in t.columns if c not in ("window_id", "pos")})


@query("F9_location_features", sql("""SELECT window_id, round(avg(lat), 8) AS lat_mean, round(avg(lon), 8) AS lon_mean, round(stddev_pop(lat), 8) AS lat_std, round(stddev_pop(lon), 8) AS lon_std, min(lat) AS lat_min, max(lat) AS lat_max,
    min(lon) AS lon_min, max(lon) AS lon_max FROM win GROUP BY window_id""", "win"))
def f9(d):
    return rounded(features.location_features(d.windows()), lat_mean=8, lon_mean=8, lat_std=8, lon_std=8)


_LOGIT = {**_F,
    "lg": (["kin", "lab"], """SELECT l.window_id, list_transform([4.5::DOUBLE, 7.0::DOUBLE, 11.0::DOUBLE, 1.4::DOUBLE], lambda c: -3 * abs(ln(k.v_p50 + 0.1::DOUBLE) - ln(c))) AS z, list_position(['bike', 'bus', 'car', 'walk'], l.mode) - 1 AS y
        FROM kin k JOIN lab l ON l.window_id = k.window_id WHERE l.split = 'test'"""),
    "pr": (["lg"], "SELECT window_id, y, list_transform(z, lambda x: exp(x - list_max(z)) / list_sum(list_transform(z, lambda q: exp(q - list_max(z))))) AS p FROM lg"),
    "pd": (["pr"], "SELECT *, list_position(p, list_max(p)) - 1 AS pred, list_max(p) AS conf FROM pr"),
}
CLASSES = ["bike", "bus", "car", "walk"]


def _rule(d):
    test = _split(d, "test")
    labels = classify.label_index(test.filter("pos = 0").select("window_id", "mode"), "mode", CLASSES)
    logits = features.speed_rule(features.kinematic_features(test), CLASSES)
    rows = logits.join(labels, "window_id").withColumnRenamed("logits", "probs")
    return classify.normalise_probs(rows)


@query("F10_normalise_probs", sql("SELECT window_id, CAST(i - 1 AS BIGINT) AS class, round(p[i], 6) AS p FROM pr, range(1, 5) r(i)", "pr", extra=_LOGIT))
def f10(d):
    return _rule(d).select("window_id", F.posexplode("probs").alias("class", "p")).select("window_id", F.col("class").cast("bigint"), F.round("p", 6).alias("p"))


@query("F11_standardise", sql("""SELECT k.window_id, round((v_mean - m1) / s1, 6) AS v_mean, round((path_m - m2) / s2, 6) AS path_m FROM kin k, (SELECT avg(v_mean) AS m1, stddev_pop(v_mean) AS s1, avg(path_m) AS m2, stddev_pop(path_m) AS s2
    FROM kin JOIN lab ON lab.window_id = kin.window_id WHERE lab.split = 'train')""", "kin", "lab", extra=_F))
def f11(d):
    k = features.kinematic_features(d.windows())
    z = features.standardise(k, features.kinematic_features(_split(d, "train")), ["v_mean", "path_m"])
    return rounded(z.select("window_id", "v_mean", "path_m"), v_mean=6, path_m=6)


@query("F13_tokens_to_latlon", sql("SELECT window_id, pos, round(lat, 7) AS lat, round(lon, 7) AS lon FROM win", "win"))
def f13(d):
    t = features.point_tokens(d.windows().withColumn("hidden", F.lit(False)))
    first = d.windows().filter("pos = 0").select("window_id", F.col("lat").alias("lat0"), F.col("lon").alias("lon0"))
    lat, lon = features.tokens_to_latlon(F.col("dx_km"), F.col("dy_km"), F.col("lat0"), F.col("lon0"))
    return t.join(first, "window_id").select("window_id", "pos", F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"))


# ------------------------------------------------------------------ K, B8-B13
@query("K_accuracy_nll", sql("SELECT window_id, (pred = y)::INT::DOUBLE AS accuracy, round(-ln(least(greatest(p[y + 1], 1e-9), 1.0)), 6) AS cls_nll FROM pd", "pd", extra=_LOGIT))
def k_acc(d):
    m = classify.sample_metrics(_rule(d), ["window_id"])
    return rounded(m.groupBy("window_id").pivot("metric", ["accuracy", "cls_nll"]).agg(F.first("value")), cls_nll=6)


@query("K_set_metrics", sql("""SELECT round((SELECT avg(r) FROM (SELECT avg((pred = y)::INT::DOUBLE) AS r FROM pd GROUP BY y)), 6) AS balanced_accuracy,
    round((SELECT avg(2 * tp / (n + np)) FROM (SELECT t.y, count(*)::DOUBLE AS n, sum((t.pred = t.y)::INT)::DOUBLE AS tp, (SELECT count(*) FROM pd q WHERE q.pred = t.y)::DOUBLE AS np FROM pd t GROUP BY t.y)), 6) AS macro_f1,
    round((SELECT sum(n * abs(a - c)) / sum(n) FROM (SELECT least(floor(conf * 10), 9) AS b, count(*)::DOUBLE AS n, avg((pred = y)::INT::DOUBLE) AS a, avg(conf) AS c FROM pd GROUP BY 1)), 6) AS ece""", "pd", extra=_LOGIT))
def k_set(d):
    return rounded(classify.set_metrics(_rule(d), []), balanced_accuracy=6, macro_f1=6, ece=6)


@query("B19_speed_rule", sql("SELECT window_id, round(z[1], 6) AS bike, round(z[4], 6) AS walk FROM lg", "lg", extra=_LOGIT))
def b19(d):
    r = features.speed_rule(features.kinematic_features(_split(d, "test")), CLASSES)
    return r.select("window_id", F.round(F.col("logits")[0], 6).alias("bike"), F.round(F.col("logits")[3], 6).alias("walk"))


@query("B8_majority", sql("""SELECT mode, round((n + 0.001::DOUBLE) / sum(n + 0.001::DOUBLE) OVER (), 9) AS p FROM (SELECT mode, count(*) AS n FROM lab WHERE split = 'train' GROUP BY mode)""", "lab", extra=_F))
def b8(d):
    rows, classes = modes.labelled(_split(d, "train"))
    p = classify.majority(rows, "y", len(classes))
    return rows.select("mode", "y").distinct().select("mode", F.round(F.array(*[F.lit(x) for x in p])[F.col("y")], 9).alias("p"))


def _kin_vectors(d, s):
    rows, _ = modes.labelled(_split(d, s), CLASSES)
    return features.as_vector(features.kinematic_features(_split(d, s)), features.KINEMATIC).join(rows, "window_id")


@query("B9_handcrafted_classifier")
def b9(d):
    return classify.tree_classifier(_kin_vectors(d, "train"), _kin_vectors(d, "test"), "window_id").select("window_id", "y", F.array_max("probs").alias("conf"))


@query("B10_linear_probe")
def b10(d):
    e = d.table("embeddings").withColumn("y", F.col("label").cast("int"))
    train, test = e.filter(uniform(0, "embsplit", F.col("vec_id")) < 0.8), e.filter(uniform(0, "embsplit", F.col("vec_id")) >= 0.8)
    return classify.linear_probe(train, test, "vec_id", "embedding").select("vec_id", "y", F.array_max("probs").alias("conf"))


@query("B11_mean_location_classifier")
def b11(d):
    part = lambda s: features.as_vector(features.location_features(_split(d, s)), features.PLACE).join(modes.labelled(_split(d, s), CLASSES)[0], "window_id")
    return classify.linear_probe(part("train"), part("test"), "window_id").select("window_id", "y", F.array_max("probs").alias("conf"))


@query("B12_max_step", sql(f"""SELECT window_id, round(max(s), 4) AS score FROM (SELECT window_id, {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS s FROM win WHERE split = 'test' WINDOW w AS (PARTITION BY window_id ORDER BY pos)) GROUP BY window_id""", "win"))
def b12(d):
    return rounded(features.max_step(_split(d, "test")), score=4)


_Z = " + ".join(f"pow((a.{c} - b.{c}) / s.{c}, 2)" for c in features.KINEMATIC)


@query("B13_kinematic_knn", sql(f"""SELECT window_id, round(avg(sqrt(d2)), 5) AS score FROM (SELECT a.window_id, {_Z} AS d2, row_number() OVER (PARTITION BY a.window_id ORDER BY {_Z}) AS r
    FROM kin a JOIN lab la ON la.window_id = a.window_id AND la.split = 'test', kin b JOIN lab lb ON lb.window_id = b.window_id AND lb.split = 'train',
      (SELECT {', '.join(f"CASE WHEN stddev_pop({c}) > 1e-12 THEN stddev_pop({c}) ELSE 1 END AS {c}" for c in features.KINEMATIC)} FROM kin JOIN lab ON lab.window_id = kin.window_id WHERE lab.split = 'train') s)
    WHERE r <= 10 GROUP BY window_id""", "kin", "lab", extra=_F))
def b13(d):
    k = detection.kinematic_knn(features.kinematic_features(_split(d, "train")), features.kinematic_features(_split(d, "test")), "window_id", features.KINEMATIC, 10)
    return rounded(k, score=5)


# ------------------------------------------------------------------ A
_EMB = {"em": ([], f"SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v, {sql_uniform(0, 'embsplit', 'vec_id')} < 0.8 AS train FROM embeddings"),
        "ml": (["em"], "SELECT vec_id, train, i, v[i] AS x FROM em, range(1, 65) r(i)"),
        "ms": (["ml"], "SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM ml WHERE train GROUP BY i"),
        "zz": (["ml", "ms"], "SELECT vec_id, train, list((x - m) / CASE WHEN s > 1e-12 THEN s ELSE 1 END ORDER BY ml.i) AS z FROM ml JOIN ms ON ms.i = ml.i GROUP BY vec_id, train"),
        "kd": (["zz"], "SELECT a.vec_id, list_distance(a.z, b.z) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.z, b.z)) AS r FROM zz a, zz b WHERE NOT a.train AND b.train")}


def _emb(d):
    e = d.table("embeddings")
    u = uniform(0, "embsplit", F.col("vec_id"))
    return e.filter(u < 0.8), e.filter(u >= 0.8)


@query("A1_knn_distance", sql("SELECT vec_id, round(avg(d), 5) AS score FROM kd WHERE r <= 10 GROUP BY vec_id", "kd", extra=_EMB))
def a1(d):
    train, test = _emb(d)
    return rounded(detection.knn_distance(train, test, "vec_id", "embedding", 10), score=5)


@query("A2_mahalanobis_distance")
def a2(d):
    train, test = _emb(d)
    return rounded(detection.mahalanobis_distance(train, test, "vec_id", "embedding"), score=5)


# scores with many ties, some missing: label from md5 order
_SC = {"sc": (["fixes"], f"SELECT event_id, mode, {sql_uniform(1, 'label', 'event_id')} < 0.2 AS y, CASE WHEN event_id % 50 = 0 THEN NULL ELSE floor(({sql_uniform(1, 'score', 'event_id')} + CASE WHEN {sql_uniform(1, 'label', 'event_id')} < 0.2 THEN 0.3 ELSE 0 END) * 40) END AS s0 FROM fixes"),
       "sd": (["sc"], "SELECT event_id, mode, y, coalesce(s0, min(s0) OVER (PARTITION BY mode) - 1)::DOUBLE AS s FROM sc"),
       "tg": (["sd"], "SELECT mode, s, count(*) AS n, sum(y::INT) AS pos FROM sd GROUP BY mode, s"),
       "tc": (["tg"], "SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(n) OVER (PARTITION BY mode) AS na, sum(pos) OVER (PARTITION BY mode) AS np FROM tg WINDOW w AS (PARTITION BY mode ORDER BY s DESC)")}


def _scored(d):
    e = F.col("event_id")
    y = uniform(1, "label", e) < 0.2
    s = F.floor((uniform(1, "score", e) + F.when(y, 0.3).otherwise(0.0)) * 40).cast("double")
    return d.fixes().select("event_id", "mode", y.alias("y"), F.when(e % 50 != 0, s).alias("score"))


@query("A_roc", sql("""SELECT mode, round(sum(CASE WHEN a.s > b.s THEN 1.0::DOUBLE WHEN a.s = b.s THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END * a.pos * (b.n - b.pos)) / (any_value(a.np) * (any_value(a.na) - any_value(a.np))), 6) AS roc_auc
    FROM tc a JOIN tc b USING (mode) GROUP BY mode""", "tc", extra=_SC))
def a_roc(d):
    return rounded(detection.detection_metrics(_scored(d), ["mode"]).select("mode", "roc_auc"), roc_auc=6)


@query("A_pr", sql("SELECT mode, round(sum(pos::DOUBLE / np * (cp::DOUBLE / cn)), 6) AS pr_auc FROM tc GROUP BY mode", "tc", extra=_SC))
def a_pr(d):
    return rounded(detection.detection_metrics(_scored(d), ["mode"]).select("mode", "pr_auc"), pr_auc=6)


@query("A_pk", sql("SELECT mode, round((cp - pos + pos::DOUBLE * (np - (cn - n)) / n) / np, 6) AS precision_at_k FROM tc WHERE cn >= np AND cn - n < np", "tc", extra=_SC))
def a_pk(d):
    return rounded(detection.detection_metrics(_scored(d), ["mode"]).select("mode", "precision_at_k"), precision_at_k=6)


@query("A_nan", sql("SELECT event_id, s AS score FROM sd", "sd", extra=_SC))
def a_nan(d):
    return detection.finite_last(_scored(d), ["mode"]).select("event_id", "score")


# ------------------------------------------------------------------ Q, B14
@query("Q_rank", sql(f""", u AS (SELECT vec_id, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda q: q * q))), 1e-12)) AS a FROM em),
    n AS (SELECT e.vec_id, list_transform(range(1, 65), lambda i: v[i] + 0.2::DOUBLE * ((CAST('0x' || substr(md5(concat_ws('|', '3', 'noise', CAST(e.vec_id AS VARCHAR), CAST(i - 1 AS VARCHAR))), 1, 15) AS BIGINT))::DOUBLE / 1152921504606846976.0::DOUBLE - 0.5::DOUBLE)) AS v FROM em e),
    q AS (SELECT vec_id, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda q: q * q))), 1e-12)) AS a FROM n),
    s AS (SELECT q.vec_id, u.vec_id AS other, round(list_dot_product(q.a, u.a), 9) AS sim FROM q, u)
    SELECT s.vec_id, count(*) AS rank FROM s JOIN s t ON t.vec_id = s.vec_id AND t.other = s.vec_id WHERE s.sim >= t.sim GROUP BY s.vec_id""", "em", extra=_EMB))
def q_rank(d):
    e = d.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    noisy = e.withColumn("vector", F.transform("vector", lambda x, i: x + 0.2 * (uniform(3, "noise", F.col("vec_id"), i) - 0.5)))
    return retrieval.cosine_ranks(noisy, e, "vec_id")


_HD = {"hq": (["win", "grid"], "SELECT window_id, pos, (lon - g.lon0) * g.kx AS x, (lat - g.lat0) * (0.017453292519943295::DOUBLE * 6371008.8::DOUBLE) AS y FROM win, grid g WHERE split = 'test'"),
       "pw": (["hq"], "SELECT a.window_id AS q, b.window_id AS w, a.pos AS ap, b.pos AS bp, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM hq a, hq b WHERE a.pos % 2 = 1 AND b.pos % 2 = 0"),
       "hd": (["pw"], """SELECT q, w, round(greatest((SELECT 0.0::DOUBLE), max(m)), 6) AS h FROM (SELECT q, w, ap AS p, 0 AS side, min(d) AS m FROM pw GROUP BY q, w, ap UNION ALL SELECT q, w, bp, 1, min(d) FROM pw GROUP BY q, w, bp) GROUP BY q, w""")}


@query("B14_hausdorff_ranks", sql("SELECT a.q AS window_id, count(*) AS rank FROM hd a JOIN hd t ON t.q = a.q AND t.w = a.q WHERE a.h <= t.h GROUP BY a.q", "hd", extra=_HD))
def b14(d):
    odd, even = views.odd_even_views(_split(d, "test"))
    g = d.grid()
    return retrieval.hausdorff_ranks(odd, even, g.lat0, g.lon0)


@query("B14_random_ranks", sql(f"SELECT window_id, 1 + {sql_draw(0, 'rank', 'window_id')} % 500 AS rank FROM lab", "lab", extra=_F))
def b14r(d):
    return retrieval.random_ranks(d.windows().filter("pos = 0"), 500, "window_id", 0)


_QC = {**_REGION, "el": (["win", "rid"], "SELECT DISTINCT w.window_id, r.region AS element FROM win w JOIN rid r ON r.traj_id = w.traj_id AND r.t = w.t WHERE w.split = 'test'"),
       "vec": (["win"], "SELECT window_id, [avg(lat) - 55.62::DOUBLE, avg(lon) - 12.52::DOUBLE, stddev_pop(lat), stddev_pop(lon)] AS v FROM win WHERE split = 'test' GROUP BY window_id"),
       "un": (["vec"], "SELECT window_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda q: q * q)))) AS a FROM vec"),
       "tp": (["un"], "SELECT q.window_id, u.window_id AS match, row_number() OVER (PARTITION BY q.window_id ORDER BY round(list_dot_product(q.a, u.a), 9) DESC, u.window_id) - 1 AS place FROM un q, un u")}


@query("Q_cov", sql("""SELECT e.window_id, round(count(*) FILTER (WHERE e.element IN (SELECT x.element FROM tp JOIN el x ON x.window_id = tp.match WHERE tp.window_id = e.window_id AND place < 1)) / count(*), 6) AS cr1,
    round(count(*) FILTER (WHERE e.element IN (SELECT x.element FROM tp JOIN el x ON x.window_id = tp.match WHERE tp.window_id = e.window_id AND place < 5)) / count(*), 6) AS cr5 FROM el e GROUP BY e.window_id""", "el", "tp", extra=_QC))
def q_cov(d):
    test = _split(d, "test")
    ids = G.RegionGrid.fit(d.points()).ids(test, d.points())
    elements = ids.select("window_id", F.col("region").alias("element")).distinct()
    f = features.location_features(test)
    vec = f.select("window_id", F.array(F.col("lat_mean") - 55.62, F.col("lon_mean") - 12.52, "lat_std", "lon_std").alias("vector"))
    m = retrieval.coverage(retrieval.cosine_top(vec, vec, "window_id"), elements, "window_id")
    w = m.groupBy("window_id").pivot("metric", ["cr@1", "cr@5"]).agg(F.first("value"))
    return rounded(w.select("window_id", F.col("`cr@1`").alias("cr1"), F.col("`cr@5`").alias("cr5")), cr1=6, cr5=6)


@query("H17_retrieval_eval")
def h17(d):
    g = d.grid()
    return retrieval_plan.odd_even_eval(_split(d, "test"), g.lat0, g.lon0)


def _place(windows):
    """Mean position against a fixed centre and spread of a window, as _QC has them."""
    f = features.location_features(windows)
    return f.select("window_id", F.array(F.col("lat_mean") - 55.62, F.col("lon_mean") - 12.52, "lat_std", "lon_std").alias("vector"))


@query("H17_cross_representation", sql("""SELECT m.metric, round(avg(CASE m.metric WHEN 'mean_rank' THEN rank WHEN 'mrr' THEN 1.0::DOUBLE / rank ELSE (rank <= CAST(split_part(m.metric, '@', 2) AS INT))::INT::DOUBLE END), 6) AS value, count(*) AS n
    FROM (SELECT s.window_id, count(*) AS rank FROM sm s JOIN sm t ON t.window_id = s.window_id AND t.other = s.window_id WHERE s.sim >= t.sim GROUP BY s.window_id) r, (VALUES ('mean_rank'), ('mrr'), ('hr@1'), ('hr@5'), ('hr@10')) m(metric) GROUP BY m.metric""", "sm", extra={**_QC,
    "rq": (["win"], "SELECT window_id, [avg(lat) - 55.62::DOUBLE, avg(lon) - 12.52::DOUBLE, stddev_pop(lat), stddev_pop(lon)] AS v FROM (SELECT window_id, pos, round(lat, 2) AS lat, round(lon, 2) AS lon FROM win WHERE split = 'test') GROUP BY window_id"),
    "qn": (["rq"], "SELECT window_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda q: q * q)))) AS a FROM rq"),
    "sm": (["qn", "un"], "SELECT q.window_id, u.window_id AS other, round(list_dot_product(q.a, u.a), 9) AS sim FROM qn q, un u")}))
def h17_cross(d):
    """The window is looked for by an embedding of the cells of 0.01 degrees that it passes."""
    g, test = d.grid(), _split(d, "test")
    coarse = lambda w: _place(w.withColumns({"lat": F.round("lat", 2), "lon": F.round("lon", 2)}))
    r = retrieval_plan.cross_representation_eval(test, {"region": coarse}, _place, g.lat0, g.lon0)
    return rounded(r.filter("model = 'model'").select("metric", "value", "n"), value=6)


@query("H17_cross_topology")
def h17_topology(d):
    g, test = d.grid(), _split(d, "test")
    return retrieval_plan.cross_representation_eval(test, {"topology": lambda w: _place(retrieval_plan.topology_points(w))}, _place, g.lat0, g.lon0)


@query("H17_condition", sql("""SELECT m.metric, round(avg(CASE m.metric WHEN 'cr@1' THEN cr1 ELSE cr5 END), 6) AS value, count(*) AS n FROM (SELECT e.window_id,
        count(*) FILTER (WHERE e.element IN (SELECT x.element FROM tp JOIN el x ON x.window_id = tp.match WHERE tp.window_id = e.window_id AND place < 1)) / count(*) AS cr1,
        count(*) FILTER (WHERE e.element IN (SELECT x.element FROM tp JOIN el x ON x.window_id = tp.match WHERE tp.window_id = e.window_id AND place < 5)) / count(*) AS cr5 FROM el e GROUP BY e.window_id) c,
    (VALUES ('cr@1'), ('cr@5')) m(metric) GROUP BY m.metric""", "el", "tp", extra=_QC))
def h17_condition(d):
    test = _split(d, "test")
    regions = G.RegionGrid.fit(d.points()).ids(test, d.points()).select("window_id", F.col("region").alias("element")).distinct()
    r = retrieval_plan.condition_eval(test, {"region": regions}, {"region": _place}, _place)
    return rounded(r.filter("model = 'model'").select("metric", "value", "n"), value=6)


# ------------------------------------------------------------------ U, H7, H8
@query("H7_mode_eval")
def h7(d):
    records, sets = modes.mode_eval(_split(d, "train"), _split(d, "test"), (1.0, 0.1), (0,),
                                    {"speed_rule": _rule(d).select("window_id", "probs")})
    return records.select("task", "eval_seed", "model", "metric", "value").unionByName(sets)


@query("H8_user_cohort", sql("""SELECT user_id, n_train, n_test, row_number() OVER (ORDER BY user_id) - 1 AS y FROM (SELECT user_id, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'test') AS n_test FROM lab
    GROUP BY user_id HAVING count(*) FILTER (WHERE split = 'train') >= 3 AND count(*) FILTER (WHERE split = 'test') >= 1 ORDER BY least(n_train, n_test) DESC, user_id LIMIT 20)""".replace("HAVING count(*) FILTER (WHERE split = 'train') >= 3 AND count(*) FILTER (WHERE split = 'test') >= 1 ORDER", "HAVING least(count(*) FILTER (WHERE split = 'train'), count(*) FILTER (WHERE split = 'test')) >= 1 ORDER"), "lab", extra=_F))
def h8(d):
    return longs(classify.user_cohort(d.windows(), 1, 20), "y")


@query("H8_user_identification")
def h8b(d):
    vec = features.as_vector(features.kinematic_features(d.windows()), features.KINEMATIC).select("window_id", "vector")
    records, f1 = identity.identity_eval(d.windows(), {"kinematics": vec}, 1, 20)
    return records.select("task", "model", "metric", "value", "skill")


@query("U_identity_metrics", sql("""SELECT window_id, (r <= 1)::INT::DOUBLE AS acc1, (r <= 5)::INT::DOUBLE AS acc5, CASE WHEN r <= 20 THEN round(1.0 / r, 6) ELSE 0 END AS mrr20, round(-ln((1 - 1e-6) * t + 1e-6 / 25), 6) AS nll FROM
    (SELECT window_id, p[y + 1] AS t, len(list_filter(p, lambda x: x >= p[y + 1])) AS r FROM
      (SELECT window_id, y, list_transform(w, lambda x: x / list_sum(w)) AS p FROM (SELECT window_id, %s %% 25 AS y,
         list_transform(range(0, 25), lambda i: 1.0::DOUBLE + (CAST('0x' || substr(md5(concat_ws('|', '2', 'p', window_id, CAST(i AS VARCHAR))), 1, 15) AS BIGINT)) %% 40) AS w FROM lab)))""" % sql_draw(2, "y", "window_id"), "lab", extra=_F))
def u_id(d):
    from wayspark.functions.draws import draw_int
    w = d.windows().filter("pos = 0")
    raw = F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: 1.0 + F.pmod(draw_int(2, "p", F.col("window_id"), i), F.lit(40)))
    rows = classify.normalise_probs(w.select("window_id", F.pmod(draw_int(2, "y", F.col("window_id")), F.lit(25)).cast("int").alias("y"),
                                             classify.shares(raw).alias("probs")))
    m = classify.identity_metrics(rows, ["window_id"], 25)
    p = m.groupBy("window_id").pivot("metric", ["user_acc@1", "user_acc@5", "user_mrr@20", "user_nll"]).agg(F.first("value"))
    return rounded(p.toDF("window_id", "acc1", "acc5", "mrr20", "nll"), mrr20=6, nll=6)


# ------------------------------------------------------------------ H9-H16
_I = lambda salt, *k: sql_uniform(0, salt, *k)
_INJ = {
    "wt": (["win"], "SELECT * FROM win WHERE split = 'test'"),
    "bad": (["wt"], f"SELECT window_id FROM (SELECT DISTINCT window_id FROM wt) ORDER BY {sql_hex(0, 'bad', 'window_id')}, window_id LIMIT (SELECT CAST(least(greatest(1, round_even(0.1::DOUBLE * count(*), 0)), count(*) - 1) AS BIGINT) FROM wt WHERE pos = 0)"),
    "ctr": (["wt"], "SELECT avg(lat) AS lat0, avg(lon) AS lon0, 0.017453292519943295::DOUBLE * 6371008.8::DOUBLE * cos(radians(avg(lat))) AS kx, 0.017453292519943295::DOUBLE * 6371008.8::DOUBLE AS ky FROM wt"),
    "ix": (["wt", "ctr", "bad"], f"""SELECT *, 1 + sd % (greatest(8 - n, 2) - 1) AS s, 1 + sd % (greatest(8 - n, 2) - 1) + n AS e FROM (SELECT w.window_id, w.pos, w.t, (w.lon - c.lon0) * c.kx AS x, (w.lat - c.lat0) * c.ky AS y, c.*,
        CAST(least(greatest(round_even(8 * (0.3::DOUBLE + 0.3::DOUBLE * {_I('span', 'w.window_id')}), 0), 2), 6) AS BIGINT) AS n, {sql_draw(0, 'start', 'w.window_id')} AS sd FROM wt w JOIN bad b ON b.window_id = w.window_id, ctr c)"""),
    "st": (["ix"], "SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM ix WINDOW w AS (PARTITION BY window_id ORDER BY pos)"),
    "sm": (["st"], f"""SELECT a.*, b.dx AS mx, b.dy AS my, a.pos - 1 >= a.s AND a.pos - 1 < a.e AS inside, 3.141592653589793::DOUBLE / 3 + 4 * 3.141592653589793::DOUBLE / 3 * {_I('angle', 'a.window_id')} AS ang
        FROM st a LEFT JOIN st b ON b.window_id = a.window_id AND b.pos - 1 = a.s + a.e - 1 - (a.pos - 1)"""),
    "sx": (["sm"], """SELECT *, CASE WHEN pos = 0 THEN 0 WHEN inside THEN dx * 6 ELSE dx END AS fx, CASE WHEN pos = 0 THEN 0 WHEN inside THEN dy * 6 ELSE dy END AS fy,
        CASE WHEN pos = 0 THEN 0 WHEN inside THEN cos(ang) * dx - sin(ang) * dy ELSE dx END AS rx, CASE WHEN pos = 0 THEN 0 WHEN inside THEN sin(ang) * dx + cos(ang) * dy ELSE dy END AS ry,
        CASE WHEN pos = 0 THEN 0 WHEN inside THEN -mx ELSE dx END AS lx, CASE WHEN pos = 0 THEN 0 WHEN inside THEN -my ELSE dy END AS ly FROM sm"""),
    "inj": (["sx"], f"""SELECT window_id, pos, 'teleport' AS kind, CASE WHEN pos >= s AND pos < e THEN y + (5 + 45 * {_I('far', 'window_id')}) * 1000 * sin(2 * pi() * {_I('bearing', 'window_id')}) ELSE y END / ky + lat0 AS lat,
          CASE WHEN pos >= s AND pos < e THEN x + (5 + 45 * {_I('far', 'window_id')}) * 1000 * cos(2 * pi() * {_I('bearing', 'window_id')}) ELSE x END / kx + lon0 AS lon FROM sx
        UNION ALL SELECT window_id, pos, 'speed', (first_value(y) OVER w + sum(fy) OVER w) / ky + lat0, (first_value(x) OVER w + sum(fx) OVER w) / kx + lon0 FROM sx WINDOW w AS (PARTITION BY window_id ORDER BY pos)
        UNION ALL SELECT window_id, pos, 'noise', (y + 300 * {sql_normal(0, 'y', 'window_id', 'pos')}) / ky + lat0, (x + 300 * {sql_normal(0, 'x', 'window_id', 'pos')}) / kx + lon0 FROM sx
        UNION ALL SELECT window_id, pos, 'detour', (first_value(y) OVER w + sum(ry) OVER w) / ky + lat0, (first_value(x) OVER w + sum(rx) OVER w) / kx + lon0 FROM sx WINDOW w AS (PARTITION BY window_id ORDER BY pos)
        UNION ALL SELECT window_id, pos, 'loop', (first_value(y) OVER w + sum(ly) OVER w) / ky + lat0, (first_value(x) OVER w + sum(lx) OVER w) / kx + lon0 FROM sx WINDOW w AS (PARTITION BY window_id ORDER BY pos)"""),
    "injall": (["inj", "wt"], """SELECT k.kind, w.window_id, w.pos, w.t, coalesce(i.lat, w.lat) AS lat, coalesce(i.lon, w.lon) AS lon, i.lat IS NOT NULL AS is_bad FROM wt w CROSS JOIN (VALUES ('teleport'), ('speed'), ('noise'), ('detour'), ('loop')) k(kind)
        LEFT JOIN inj i ON i.window_id = w.window_id AND i.pos = w.pos AND i.kind = k.kind"""),
}


def _injected(d):
    return inject.inject(_split(d, "test"), LENGTH)


for _n, _kind in zip((9, 10, 11, 12, 13), inject.KINDS):
    query(f"H{_n}_inject_{_kind}", sql(f"SELECT window_id, pos, round(lat, 7) AS lat, round(lon, 7) AS lon FROM inj WHERE kind = '{_kind}'", "inj", extra=_INJ))(
        lambda d, k=_kind: rounded(_injected(d).filter((F.col("kind") == k) & F.col("is_bad")).select("window_id", "pos", "lat", "lon"), lat=7, lon=7))


@query("H14_injection_rules", sql("""SELECT kind, window_id, concat(any_value(t.traj_id), '#anom:', kind, ':0') AS traj_id, bool_or(is_bad) AS is_bad, CAST(count(*) AS BIGINT) AS n FROM injall i JOIN (SELECT DISTINCT window_id, traj_id FROM win) t USING (window_id) GROUP BY kind, window_id""", "injall", "win", extra=_INJ))
def h14(d):
    return _injected(d).groupBy("kind", "window_id").agg(F.min("traj_id").alias("traj_id"), F.bool_or("is_bad").alias("is_bad"), F.count(F.lit(1)).alias("n"))


_CHK = {**_INJ,
    "so": (["wt", "bad"], f"SELECT window_id, d, row_number() OVER (PARTITION BY window_id ORDER BY d) AS r FROM (SELECT w.window_id, {hav('lag(lat) OVER w2', 'lag(lon) OVER w2', 'lat', 'lon')} AS d FROM wt w JOIN bad b ON b.window_id = w.window_id WINDOW w2 AS (PARTITION BY w.window_id ORDER BY pos)) WHERE d IS NOT NULL"),
    "sn": (["inj"], f"SELECT kind, window_id, d, row_number() OVER (PARTITION BY kind, window_id ORDER BY d) AS r FROM (SELECT kind, window_id, {hav('lag(lat) OVER w2', 'lag(lon) OVER w2', 'lat', 'lon')} AS d FROM inj WINDOW w2 AS (PARTITION BY kind, window_id ORDER BY pos)) WHERE d IS NOT NULL"),
}


@query("H15_injection_check", sql("""SELECT kind, round(max(dev), 5) AS step_length_deviation, round(quantile_cont(mr, 0.5), 5) AS max_step_ratio, round(quantile_cont(tr, 0.5), 5) AS total_distance_ratio FROM
    (SELECT n.kind, n.window_id, max(abs(n.d - o.d) / greatest(o.d, 1)) AS dev, max(n.d) / greatest(max(o.d), 1e-9) AS mr, sum(n.d) / greatest(sum(o.d), 1e-9) AS tr FROM sn n JOIN so o ON o.window_id = n.window_id AND o.r = n.r GROUP BY n.kind, n.window_id)
    GROUP BY kind""", "sn", "so", extra=_CHK))
def h15(d):
    c = inject.injection_check(_split(d, "test"), _injected(d))
    return rounded(c, step_length_deviation=5, max_step_ratio=5, total_distance_ratio=5)


_AN = {**_INJ, "stp": (["injall"], f"SELECT kind, window_id, bool_or(is_bad) AS y, max(d) AS s FROM (SELECT *, {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS d FROM injall WINDOW w AS (PARTITION BY kind, window_id ORDER BY pos)) GROUP BY kind, window_id")}


@query("H16_max_step_auc", sql("""SELECT a.kind, round(avg(CASE WHEN a.s > b.s THEN 1.0::DOUBLE WHEN a.s = b.s THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END), 4) AS roc_auc FROM stp a JOIN stp b ON a.kind = b.kind WHERE a.y AND NOT b.y GROUP BY a.kind""", "stp", extra=_AN))
def h16b(d):
    flat = anomaly._flat(_injected(d))
    labels = flat.filter("pos = 0").select("kind", "case", F.col("is_bad").alias("y"))
    rows = features.max_step(flat, "case").join(labels, "case")
    return rounded(detection.detection_metrics(rows, ["kind"]).select("kind", "roc_auc"), roc_auc=4)


@query("H16_anomaly_eval")
def h16(d):
    return anomaly.anomaly_eval(anomaly.anomaly_scores(_split(d, "train"), _split(d, "test"), LENGTH))
