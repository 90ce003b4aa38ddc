"""Queries: normalisation, correlation, audits, sampling, urban form, geostatistics, functions and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatloom.functions import columns as C
from heatloom.operators import audit, clean, geostat, sampling, stats, urban
from heatloom.plans.base import GRID, HOURLY, OBS, STATIC, cells, grid, obs, query, runs, static, table
from heatloom.plans.heat import hourly_of
from heatloom.sources import io

FEATURES = ["avg_height", "building_density", "ndvi_mean", "svf", "roughness"]
LONG = STATIC + ", long AS (SELECT unnest(['avg_height', 'building_density', 'ndvi_mean', 'svf', 'roughness']) AS variable, unnest([avg_height, building_density, ndvi_mean, svf, roughness]) AS value, y, x FROM static)"
STATS = LONG + ", stats AS (SELECT variable, avg(value) AS mean, stddev_pop(value) AS std_raw, greatest(stddev_pop(value), 0.01) AS std FROM long GROUP BY 1)"


@query(f"WITH {STATS} SELECT variable, mean, std_raw, std_raw < 0.01 AS near_zero, std FROM stats", "mean std_raw std")
def norm_stats(spark, d):
    """A10."""
    return stats.norm_stats(static(spark, d), FEATURES)


TRAIN = GRID + ", tr AS (SELECT unnest(['pred_c', 't_c']) AS variable, unnest([pred_c, t_c]) AS value FROM grid WHERE time >= TIMESTAMP '1994-01-03' AND time <= TIMESTAMP '1996-01-01')"


@query(f"WITH {TRAIN} SELECT variable, avg(value) AS mean, stddev_pop(value) AS std_raw, stddev_pop(value) < 0.01 AS near_zero, greatest(stddev_pop(value), 0.01) AS std FROM tr GROUP BY 1", "mean std_raw std")
def norm_stats_train(spark, d):
    """A10, of the training period alone, its last step included."""
    return stats.norm_stats(grid(spark, d), ["pred_c", "t_c"], period=("1994-01-03", "1996-01-01"))


@query(f"WITH {STATS} SELECT y, x, variable, (value - mean) / (std + 1e-6) AS value FROM long JOIN stats USING (variable)", "value")
def zscore(spark, d):
    """A11."""
    s = static(spark, d)
    return stats.zscore(stats.long_form(s, FEATURES, ["y", "x"]), stats.norm_stats(s, FEATURES))


@query(f"WITH {STATS} SELECT y, x, variable, value / 3 * std + mean AS value FROM long JOIN stats USING (variable)", "value")
def denorm(spark, d):
    s = static(spark, d)
    return stats.denorm(stats.long_form(s, FEATURES, ["y", "x"]).withColumn("value", F.col("value") / 3), stats.norm_stats(s, FEATURES))


@query(f"WITH {LONG} SELECT variable, avg(CAST(value IS NULL AS DOUBLE)) AS nan_fraction, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, 100 * avg(CAST(value = 0 AS DOUBLE)) AS zero_pct FROM long GROUP BY 1", "nan_fraction mean std min max zero_pct")
def summarise_vars(spark, d):
    """A21."""
    return stats.summarise_vars(static(spark, d), FEATURES)


PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]
CORR = f"{STATIC}, corr_ AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM static" for a, b in PAIRS) + ")"


@query(f"WITH {CORR} SELECT * FROM corr_", "r")
def corr_matrix(spark, d):
    """A22."""
    return stats.corr_matrix(static(spark, d), FEATURES)


@query(f"WITH {STATIC} " + " UNION ALL ".join(f"SELECT '{c}' AS variable, corr({c}, avg_height) AS r FROM static" for c in FEATURES[1:]), "r")
def corr_with_target(spark, d):
    """A23."""
    return stats.corr_with_target(static(spark, d), FEATURES[1:], "avg_height")


@query()
def vif(spark, d):
    """A24."""
    return stats.vif(static(spark, d), FEATURES)


@query(f"WITH {CORR} SELECT a, b, r FROM corr_ WHERE abs(r) >= 0.01 ORDER BY abs(r) DESC, a, b LIMIT 5", "r")
def top_pairs(spark, d):
    """T3, a report of the strongest pairs."""
    return stats.top_pairs(stats.corr_matrix(static(spark, d), FEATURES), 0.01, 5)


@query()
def feature_drop_candidates(spark, d):
    """T7."""
    s = static(spark, d)
    pairs = stats.corr_matrix(s, FEATURES)
    return stats.feature_drop_candidates(stats.vif(s, FEATURES), stats.corr_with_target(s, FEATURES[1:], "avg_height"), pairs, [("building_density", "roughness"), ("avg_height", "roughness")])


@query(f"WITH {STATIC}, r AS (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, corr({c}, avg_height) AS r FROM static" for c in FEATURES[1:]) + ") SELECT variable, r FROM r WHERE NOT isnan(r) AND abs(r) < 0.10", "r")
def weak_inputs(spark, d):
    """T7, coarse inputs that hardly correlate with the target."""
    return stats.weak_inputs(stats.corr_with_target(static(spark, d), FEATURES[1:], "avg_height"))


SCALE = STATIC + ", q AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.02) AS a_{c}, quantile_cont({c}, 0.98) AS b_{c}" for c in FEATURES[:3]) + " FROM static)"


@query(f"WITH {SCALE} SELECT p_partkey, " + ", ".join(f"least(greatest(({c} - a_{c}) / (b_{c} - a_{c}), 0), 1) AS {c}" for c in FEATURES[:3]) + " FROM static, q", " ".join(FEATURES[:3]))
def robust_scale(spark, d):
    """A33."""
    return stats.robust_scale(static(spark, d), FEATURES[:3]).select("p_partkey", *FEATURES[:3])


@query()
def bootstrap_mean_ci(spark, d):
    """A14."""
    return stats.bootstrap_mean_ci(runs(spark, d), ["model"])


@query()
def bootstrap_delta_ci(spark, d):
    """A15."""
    return stats.bootstrap_delta_ci(runs(spark, d), "5-LOW")


@query("WITH v AS (SELECT unnest(['a', 'b']) AS variable, unnest([CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END, CASE WHEN o_orderkey % 5 = 0 THEN 'inf'::DOUBLE ELSE 1 END]) AS v FROM orders) SELECT variable, avg(CAST(v IS NULL OR isnan(v) AS DOUBLE)) AS null_ratio, avg(CAST(coalesce(isinf(v), false) AS DOUBLE)) AS inf_ratio FROM v GROUP BY 1", "null_ratio inf_ratio")
def nan_budget(spark, d):
    """A25."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("a"), F.when(k % 5 == 0, float("inf")).otherwise(1.0).alias("b"))
    return audit.nan_budget(rows, ["a", "b"])


BOUNDS = [("train", "2024-01-01", "2024-01-20"), ("val", "2024-01-20", "2024-01-25"), ("test", "2024-01-25", "2024-02-10")]
BOUND_SQL = "b(split, a, b) AS (VALUES " + ", ".join(f"('{n}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for n, a, b in BOUNDS) + ")"


@query(f"WITH {HOURLY}, {BOUND_SQL}, p AS (SELECT split, date_diff('hour', b.a, b.b) AS expected, (SELECT count(DISTINCT time) FROM hourly WHERE time >= b.a AND time < b.b) AS present FROM b) SELECT split, present, expected, 100.0::DOUBLE * present / expected AS pct, CASE WHEN 100.0 * present / expected >= 95 THEN 'good' WHEN 100.0 * present / expected >= 80 THEN 'fair' ELSE 'poor' END AS grade FROM p", "pct")
def split_coverage(spark, d):
    """A26."""
    return audit.split_coverage(obs(spark, d), BOUNDS)


@query(f"WITH {OBS}, {BOUND_SQL} SELECT o.time, o.station_id, o.obs_c, b.split FROM obs o LEFT JOIN b ON o.time >= b.a AND o.time < b.b")
def label_split(spark, d):
    """P4."""
    return clean.label_split(obs(spark, d).select("time", "station_id", "obs_c"), BOUNDS)


@query(f"WITH {GRID}, t AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS n, count(*) OVER () AS c FROM (SELECT DISTINCT time FROM grid)) SELECT time, y, x, CASE WHEN n < floor(c * 0.7::DOUBLE) THEN 'train' WHEN n < floor(c * 0.7::DOUBLE) + floor(c * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM grid JOIN t USING (time)")
def label_split_fraction(spark, d):
    return clean.label_split_fraction(grid(spark, d).select("time", "y", "x"), 0.7, 0.2)


@query("SELECT l_orderkey, l_linenumber, l_shipdate AS time FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '2000-01-01' AND month(l_shipdate) IN (7, 8)")
def filter_period(spark, d):
    """P5."""
    return clean.filter_period(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp").alias("time")), "1996-01-01", "2000-01-01", [7, 8])


@query(f"WITH {OBS}, c AS (SELECT 41.2::DOUBLE + (s_suppkey // 10) * 0.01::DOUBLE AS lat, 2.0::DOUBLE + (s_suppkey % 10) * 0.03::DOUBLE AS lon FROM supplier), i AS (SELECT min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM c), o AS (SELECT min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM obs) SELECT CASE WHEN (i.b - i.a) * (i.d - i.c) > 0 THEN greatest(least(i.b, o.b) - greatest(i.a, o.a), 0) * greatest(least(i.d, o.d) - greatest(i.c, o.c), 0) / ((i.b - i.a) * (i.d - i.c)) END AS covered FROM i, o", "covered")
def bbox_overlap(spark, d):
    """A27."""
    return audit.bbox_overlap(cells(spark, d), obs(spark, d))


GAPS = HOURLY + ", g AS (SELECT station_id, lag(time) OVER (PARTITION BY station_id ORDER BY time) AS gap_from, time AS gap_to FROM hourly), gaps AS (SELECT *, date_diff('second', gap_from, gap_to) / 3600.0::DOUBLE AS hours FROM g)"


@query(f"WITH {GAPS} SELECT * FROM gaps WHERE hours > 1", "hours")
def time_gaps(spark, d):
    """W3."""
    return audit.time_gaps(hourly_of(spark, d), ["station_id"])


@query(f"WITH {GAPS} SELECT station_id, count(CASE WHEN hours > 1 THEN 1 END) AS n_gaps, quantile_cont(hours, 0.5) AS median_step_h FROM gaps GROUP BY 1", "median_step_h")
def step_summary(spark, d):
    return audit.step_summary(hourly_of(spark, d), ["station_id"])


@query(f"WITH {GAPS} SELECT * FROM gaps WHERE hours > 1 ORDER BY hours DESC, station_id, gap_from, gap_to LIMIT 20", "hours")
def largest_gaps(spark, d):
    """T4, a report of the 20 largest."""
    return audit.largest_gaps(audit.time_gaps(hourly_of(spark, d), ["station_id"]))


@query(f"WITH {HOURLY}, t AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS at, count(*) OVER () AS n FROM (SELECT DISTINCT time FROM hourly)) SELECT DISTINCT t.time FROM t JOIN range(50) i(i) ON t.at = CAST(floor(i * (n - 1) / 49.0::DOUBLE) AS BIGINT)")
def even_sample(spark, d):
    """T5, 50 evenly spaced hours."""
    return audit.even_sample(hourly_of(spark, d))


@query(f"WITH {STATS} SELECT CAST(0 AS BIGINT) AS issues, CAST(CASE WHEN (SELECT bool_or(100.0 * c / 456 < 95) FROM (SELECT count(DISTINCT date_trunc('hour', ts)) AS c FROM events WHERE ts < TIMESTAMP '2024-01-20')) THEN 1 ELSE 0 END + 0 AS BIGINT) AS warnings, 'PASS' AS verdict FROM (SELECT count(*) FROM stats)")
def coupling_report(spark, d):
    """A44."""
    s = static(spark, d)
    rules = [
        ("near_zero", "issue", stats.norm_stats(s, FEATURES).select(F.col("near_zero").alias("bad"))),
        ("nulls", "issue", audit.nan_budget(s, FEATURES).select((F.col("null_ratio") > 0).alias("bad"))),
        ("coverage", "warning", audit.split_coverage(obs(spark, d), BOUNDS[:1]).select((F.col("grade") != "good").alias("bad"))),
    ]
    return audit.coupling_report(rules)


SERIES = GRID + ", s AS (SELECT time, avg(t_c) AS value FROM grid GROUP BY 1)"


def series(spark, d):
    return grid(spark, d).groupBy("time").agg(F.avg("t_c").alias("value"))


WEIGHTS = SERIES + ", c AS (SELECT *, coalesce(abs(value - lag(value) OVER (ORDER BY time)), 0) AS change FROM s), r AS (SELECT *, pow(change - min(change) OVER (), 2) + 1e-6 AS w FROM c), tw AS (SELECT time, value, change, w / sum(w) OVER () AS weight FROM r)"


@query(f"WITH {WEIGHTS} SELECT * FROM tw", "value change weight")
def temporal_weights(spark, d):
    """W9."""
    return sampling.temporal_weights(series(spark, d), gamma=2.0)


@query(f"WITH {WEIGHTS} SELECT *, sum(weight) OVER (ORDER BY time) AS high, coalesce(sum(weight) OVER (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM tw", "value change weight high low")
def weights_cdf(spark, d):
    """W10."""
    return sampling.weights_cdf(sampling.temporal_weights(series(spark, d), gamma=2.0), ["time"])


@query(f"WITH {SERIES}, q AS (SELECT quantile_cont(value, 0.95) AS q FROM s), e AS (SELECT time, value, greatest(value - q, 0) + 1e-6 AS e FROM s, q) SELECT time, value, e / sum(e) OVER () AS weight FROM e", "value weight")
def p95_weights(spark, d):
    """R3."""
    return sampling.p95_weights(series(spark, d))


@query()
def sample_times(spark, d):
    """As many draws as there are steps."""
    s = series(spark, d)
    return sampling.sample_times(sampling.weights_cdf(sampling.temporal_weights(s), ["time"]), s.count(), 7)


@query(f"WITH {SERIES}, z AS (SELECT time, value, CAST(month(time) % 12 // 3 AS INT) AS season FROM s) SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY season) / (SELECT count(DISTINCT season) FROM z) AS weight FROM z", "value weight", 9)
def season_balanced(spark, d):
    """R2, C2."""
    return sampling.season_balanced(series(spark, d), C.season_id(F.col("time")))


@query(f"WITH {STATIC}, m AS (SELECT avg(avg_height) AS a, stddev_pop(avg_height) AS s, avg(svf) AS b, stddev_pop(svf) AS u FROM static), r AS (SELECT y, x, (abs((avg_height - a) / (s + 1e-6)) + abs((svf - b) / (u + 1e-6))) / 2 AS r FROM static, m), w AS (SELECT *, r - min(r) OVER () + 1e-6 AS w FROM r) SELECT y, x, w / sum(w) OVER () AS weight FROM w", "weight", 9)
def tile_weights(spark, d):
    """R4, by z-scores."""
    return sampling.tile_weights(static(spark, d), "static_weighted", ["avg_height", "svf"]).select("y", "x", "weight")


@query(f"WITH {STATIC}, w AS (SELECT y, x, (roughness - min(roughness) OVER ()) ** 2 + 1e-6 AS w FROM static) SELECT y, x, w / sum(w) OVER () AS weight FROM w", "weight", 9)
def tile_weights_error(spark, d):
    """R4, by known errors, squared."""
    return sampling.tile_weights(static(spark, d).withColumn("error", F.col("roughness")), "error_weighted", [], 2.0).select("y", "x", "weight")


def unit(c: str, expr: str) -> str:
    return f"CASE WHEN b_{c} > a_{c} THEN least(greatest(({expr} - a_{c}) / (b_{c} - a_{c}), 0), 1) ELSE 0 END"


UHI = {"built": "building_density", "canyon": "(1 - least(greatest(svf, 0), 1))", "height": "avg_height", "rough": "roughness", "green": "ndvi_mean"}


@query(
    f"WITH {STATIC}, q AS (SELECT " + ", ".join(f"quantile_cont({e}, 0.02) AS a_{k}, quantile_cont({e}, 0.98) AS b_{k}" for k, e in UHI.items()) + " FROM static), r AS (SELECT y, x, "
    + " + ".join(f"{w} * ({unit(k, UHI[k]) if k != 'green' else '1 - ' + unit(k, UHI[k])})" for k, w in (("built", 0.45), ("canyon", 0.25), ("height", 0.15), ("rough", 0.1), ("green", 0.05)))
    + " AS r FROM static, q), w AS (SELECT *, r - min(r) OVER () + 1e-6 AS w FROM r) SELECT y, x, w / sum(w) OVER () AS weight FROM w", "weight", 9,
)
def tile_weights_uhi(spark, d):
    """R4, the heat-island proxy."""
    return sampling.tile_weights(static(spark, d), "uhi_proxy", FEATURES).select("y", "x", "weight")


@query()
def sample_tiles(spark, d):
    """As many tiles as parts."""
    w = sampling.weights_cdf(sampling.tile_weights(static(spark, d), "static_weighted", ["avg_height", "svf"]).select("y", "x", "weight"), ["y", "x"])
    return sampling.sample_tiles(w, w.count(), (50, 40), patch=16, seed=3, lr_shape=(5, 4))


@query(f"WITH {SERIES}, n AS (SELECT time, value, row_number() OVER (ORDER BY time) - 1 AS n, count(*) OVER () AS c FROM s), w AS (SELECT n AS start, lead(time, 3) OVER (ORDER BY n) AS label_time, value + 2 * lead(value, 1) OVER (ORDER BY n) + 3 * lead(value, 2) OVER (ORDER BY n) + 4 * lead(value, 3) OVER (ORDER BY n) AS mix, c FROM n) SELECT start, label_time, mix FROM w WHERE start % 2 = 0 AND start < c - 4", "mix")
def sequences(spark, d):
    """W11; mix is a number that tells the order of the values."""
    out = sampling.sequences(series(spark, d), 4, 2)
    return out.select("start", "label_time", sum((k + 1) * F.get("values", F.lit(k)) for k in range(4)).alias("mix"))


@query()
def perturb(spark, d):
    """R7, with the spread of each noise."""
    rows = stats.long_form(static(spark, d), FEATURES[:2], ["y", "x"])
    noisy = sampling.perturb(rows, "avg_height", [0.1, 0.25, 0.5, 1.0], 40, 4, "clean")
    return noisy.groupBy("variable", "epsilon_K").agg(F.stddev_pop(F.col("value") - F.col("clean")).alias("spread"), F.count("*").alias("n"))


@query(f"WITH {OBS}, c AS (SELECT station_id FROM (SELECT DISTINCT station_id FROM obs) ORDER BY md5(station_id || ':5'), station_id LIMIT 20) SELECT * FROM obs SEMI JOIN c USING (station_id)")
def subsample_stations(spark, d):
    """20 stations, by hash."""
    return sampling.subsample_stations(obs(spark, d), 20, 5)


ANOM = HOURLY + ", h AS (SELECT station_id AS model, time, obs_c AS mean, obs_c * 1.5 AS max FROM hourly), w AS (SELECT *, row_number() OVER p AS n, abs(mean - lag(mean) OVER p) AS dm, abs(max - lag(max) OVER p) AS dx, mean - lag(mean) OVER p AS dd, abs(mean - avg(mean) OVER b) / (stddev_pop(mean) OVER b + 1e-6) AS z FROM h WINDOW p AS (PARTITION BY model ORDER BY time), b AS (PARTITION BY model ORDER BY time ROWS BETWEEN 23 PRECEDING AND 1 PRECEDING)), v AS (SELECT *, min(dd) OVER q AS lo, max(dd) OVER q AS hi, sum(dd) OVER q AS tot FROM w WINDOW q AS (PARTITION BY model ORDER BY time ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"
ANOM_NAMES = "mean_jump max_jump mean_outlier rising_trend falling_trend"
ANOMALIES = f"WITH {ANOM} SELECT model, time, CASE WHEN n >= 24 AND dm > 5 THEN dm END AS mean_jump, CASE WHEN n >= 24 AND dx > 8 THEN dx END AS max_jump, CASE WHEN n >= 24 AND z > 3 THEN z END AS mean_outlier, CASE WHEN n >= 24 AND lo > 0 AND tot > 10 THEN tot END AS rising_trend, CASE WHEN n >= 24 AND hi < 0 AND tot < -10 THEN tot END AS falling_trend FROM v"


def hour_stats(spark, d):
    return hourly_of(spark, d).select(F.col("station_id").alias("model"), "time", F.col("obs_c").alias("mean"), (F.col("obs_c") * 1.5).alias("max"))


@query(ANOMALIES, ANOM_NAMES, 5)
def anomalies(spark, d):
    """W4, W5; ST5's batch twin."""
    return sampling.anomalies(hour_stats(spark, d), ["model"])


@query(f"WITH {STATIC}, n AS (SELECT brand, count(*) AS n FROM static GROUP BY 1) SELECT p_partkey, CASE WHEN n < 80 THEN -1 ELSE CAST(substr(brand, 7) AS INT) END AS cls FROM static JOIN n USING (brand)")
def pool_rare_classes(spark, d):
    """A34."""
    rows = static(spark, d).select("p_partkey", F.substring("brand", 7, 4).cast("int").alias("cls"))
    return geostat.pool_rare_classes(rows, "cls", 80)


def residual_points(spark, d):
    s = static(spark, d)
    value = F.sin(F.col("y") / 7.0) * 4 + F.cos(F.col("x") / 5.0) * 3 + F.col("building_density")
    return s.select(F.col("p_partkey").alias("id"), (F.col("x") * 0.1).alias("x"), (F.col("y") * 0.1).alias("y"), value.alias("value"), (F.col("p_partkey") % 3).cast("int").alias("cls"))


@query(f"WITH {STATIC}, p AS (SELECT p_partkey AS id, x * 0.1::DOUBLE AS x, y * 0.1::DOUBLE AS y, sin(y / 7.0::DOUBLE) * 4 + cos(x / 5.0::DOUBLE) * 3 + building_density AS value FROM static ORDER BY md5(CAST(p_partkey AS VARCHAR) || ':0'), p_partkey LIMIT 1500), d AS (SELECT sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d, 0.5::DOUBLE * pow(a.value - b.value, 2) AS g FROM p a JOIN p b ON a.id < b.id), c AS (SELECT max(d) * 0.5 AS cut FROM d), k AS (SELECT CAST(floor(d / cut * 15) AS INT) AS bin, d, g FROM d, c WHERE d <= cut) SELECT bin, avg(d) AS lag, avg(g) AS semivariance, count(*) AS n FROM k WHERE bin < 15 GROUP BY 1 HAVING count(*) >= 10", "lag semivariance")
def variogram(spark, d):
    """A35, with the method's own sample of points."""
    return geostat.variogram(residual_points(spark, d))


@query()
def spherical_models(spark, d):
    """G4, for each class."""
    return geostat.fit_models(geostat.variogram(residual_points(spark, d), by=["cls"]), ["cls"])


@query(f"WITH {STATIC}, p AS (SELECT p_partkey AS id, x * 0.1::DOUBLE AS x, y * 0.1::DOUBLE AS y FROM static), q AS (SELECT quantile_cont(x, 0.5) AS qx, quantile_cont(y, 0.5) AS qy FROM p) SELECT id, CAST((CASE WHEN qx <= x THEN 1 ELSE 0 END) * 2 + (CASE WHEN qy <= y THEN 1 ELSE 0 END) AS INT) AS fold FROM p, q")
def block_folds(spark, d):
    """G3."""
    return geostat.block_folds(residual_points(spark, d)).select("id", "fold")


@query()
def block_cv(spark, d):
    """G5, G6."""
    return geostat.cv_summary(geostat.block_cv(residual_points(spark, d)))


@query()
def urban_metrics(spark, d):
    """Squares of parts' sizes around suppliers' places, in metres."""
    k, size = F.col("p_partkey"), F.col("p_size") * 1.0
    x, y = (k % 40) * 45.0, F.floor(k / 40) * 45.0
    corner = lambda dx, dy: F.struct((x + dx * size).alias("x"), (y + dy * size).alias("y"))
    buildings = table(spark, d, "part").select(k.alias("id"), (F.col("p_retailprice") / 100).alias("height_m"), (F.col("p_size") % 9).alias("levels"), F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)).alias("ring"))
    s = F.col("s_suppkey")
    stations = table(spark, d, "supplier").select(s.cast("string").alias("station_id"), (s % 10 * 200.0).alias("x"), (F.floor(s / 10) * 230.0).alias("y"))
    return urban.urban_metrics(urban.buffer_intersect(stations, buildings), stations)


MORPH = "density AS building_density, greatest(least(300 * sqrt(greatest(least(1 - density, 1), 1e-4)), 300), 6) AS street_width_m"


@query(
    """WITH b AS (SELECT p_partkey AS k, least(greatest(p_size * 1000 / (pi() * 22500), 0), 1) AS density, p_retailprice / 100 AS h, (p_partkey % 100) / 100.0::DOUBLE AS ndvi FROM part), w AS (SELECT *, greatest(least(300 * sqrt(greatest(least(1 - density, 1), 1e-4)), 300), 6) AS width FROM b),
r AS (SELECT *, h / width AS ratio, least(greatest(cos(atan(2 * h / width)), 0), 1) AS canyon, least(greatest((density - 0.02) / 0.23, 0), 1) AS blend FROM w)
SELECT k, density AS building_density, width AS street_width_m, ratio AS h_over_w, canyon AS svf_canyon, least(greatest(1 - blend + blend * canyon, 0), 1) AS svf, greatest(0.15 * h * (1 - exp(-sqrt(4 * density))), 0.001) AS roughness, least(greatest(0.65 * density + 0.35 * (1 - ndvi), 0), 1) AS impervious_fraction FROM r""",
    "building_density street_width_m h_over_w svf_canyon svf roughness impervious_fraction",
)
def morphology(spark, d):
    """C5."""
    k = F.col("p_partkey")
    form = C.morphology(F.col("p_size") * 1000.0, F.col("p_retailprice") / 100, k % 100 / 100.0)
    return table(spark, d, "part").select(k.alias("k"), *[c.alias(n) for n, c in form.items()])


@query(
    """WITH b AS (SELECT p_partkey AS k, p_retailprice / 100 AS h, p_size / 50.0::DOUBLE AS density, (p_partkey * 13 % 101) / 101.0::DOUBLE AS svf FROM part), r AS (SELECT *, 0.5 * tan(acos(least(greatest(svf, 1e-4), 1 - 1e-4))) AS ratio FROM b)
SELECT k, ratio AS h_over_w, least(greatest(h / (ratio + 1e-4), 6), 300) AS street_width_m, least(greatest(cos(atan(2 * ratio)), 0), 1) AS svf_canyon, density AS impervious_fraction FROM r""",
    "h_over_w street_width_m svf_canyon impervious_fraction", 4,
)
def morphology_from_svf(spark, d):
    """C5b, from the sky view."""
    k = F.col("p_partkey")
    form = C.morphology_from_svf(F.col("p_retailprice") / 100, F.col("p_size") / 50.0, k * 13 % 101 / 101.0)
    return table(spark, d, "part").select(k.alias("k"), *[c.alias(n) for n, c in form.items()])


@query(
    """WITH b AS (SELECT p_partkey AS k, p_size / 50.0::DOUBLE AS r, (p_partkey % 10) / 10.0::DOUBLE AS s, (p_partkey % 7) / 7.0::DOUBLE AS i, (p_partkey % 5) / 5.0::DOUBLE AS hi FROM part), d AS (SELECT *, 0.55::DOUBLE * r + 0.25::DOUBLE * s + 0.2::DOUBLE * i AS density, 2.5::DOUBLE + 32 * hi AS h FROM b)
SELECT k, density AS building_density, h AS avg_height, round_even(h / 3, 0) AS max_levels, round_even(density * 220, 0) AS buildings_in_buffer, h / (greatest(least(300 * sqrt(greatest(least(1 - density, 1), 1e-4)), 300), 6) + 1e-4) AS h_over_w FROM d""",
    "building_density avg_height max_levels h_over_w", 5,
)
def morphology_synthetic(spark, d):
    """C5b, from the indices."""
    k = F.col("p_partkey")
    form = C.morphology_synthetic(k % 5 / 5.0, F.lit(0.3), F.col("p_size") / 50.0, k % 7 / 7.0, k % 10 / 10.0)
    return table(spark, d, "part").select(k.alias("k"), *[form[n].alias(n) for n in ("building_density", "avg_height", "max_levels", "buildings_in_buffer", "h_over_w")])


@query("SELECT c_custkey AS k, -(c_acctbal * sin(radians(c_nationkey * 15))) AS u, -(c_acctbal * cos(radians(c_nationkey * 15))) AS v, c_acctbal - 273.15 AS celsius, c_acctbal / 1000 AS metres, c_acctbal * 3600 AS joules FROM customer", "u v celsius metres joules")
def convert_units(spark, d):
    """P12, P13."""
    a = F.col("c_acctbal")
    u, v = C.wind_components(a, F.col("c_nationkey") * 15)
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), u.alias("u"), v.alias("v"), C.kelvin_to_celsius(a).alias("celsius"), C.millimetres_to_metres(a).alias("metres"), C.watts_to_joules_per_hour(a).alias("joules"))


FOUR = ", ".join(f"{f}({n}_ * 2 * pi() * {k} / {p}) AS {n}_{f}{k}" for n, p in (("hour", 24), ("month", 12)) for k in (1, 2) for f in ("sin", "cos"))


@query(f"WITH {HOURLY} SELECT DISTINCT hour_, month_, {FOUR} FROM (SELECT CAST(hour(time) AS INT) AS hour_, CAST(month(time) AS INT) AS month_ FROM hourly)", " ".join(f"{n}_{f}{k}" for n in ("hour", "month") for k in (1, 2) for f in ("sin", "cos")))
def fourier(spark, d):
    """C3."""
    rows = hourly_of(spark, d).select(F.hour("time").alias("hour_"), F.month("time").alias("month_")).distinct()
    return rows.select("hour_", "month_", *[(F.round(c, 12) + 0.0).alias(n) for n, c in C.fourier(F.col("hour_"), F.col("month_"), 2).items()])


@query("SELECT doc_id, trim(regexp_replace(strip_accents(lower(text)), '\\s+', ' ', 'g')) AS name FROM documents")
def norm_text(spark, d):
    """C6, on whole texts."""
    return table(spark, d, "documents").select("doc_id", C.norm_text(F.col("text")).alias("name"))


@query("SELECT o_orderkey AS k, o_orderdate + to_hours(o_orderkey % 24) AS time FROM orders")
def parse_name_time(spark, d):
    """C1."""
    k = F.col("o_orderkey")
    time = F.col("o_orderdate").cast("timestamp") + F.make_interval(hours=(k % 24).cast("int"))
    name = F.concat(F.lit("pred_"), F.date_format(time, "yyyy_MM_dd_HH_mm"), F.when(k % 2 == 0, "_00").otherwise(""), F.lit(".npy"))
    return table(spark, d, "orders").select(k.alias("k"), C.parse_name_time(name).alias("time"))


@query("SELECT s_suppkey AS k, (2.0::DOUBLE + s_suppkey % 10) * (111320.0::DOUBLE * cos(radians(41.4::DOUBLE))) AS x, (41.2::DOUBLE + s_suppkey // 10) * 111320.0::DOUBLE AS y FROM supplier", "x y", 4)
def local_metres(spark, d):
    """C9."""
    k = F.col("s_suppkey")
    x, y = C.local_metres(41.2 + F.floor(k / 10), 2.0 + k % 10, 41.4)
    return table(spark, d, "supplier").select(k.alias("k"), x.alias("x"), y.alias("y"))


@query()
def laea_to_wgs84(spark, d):
    """C8; tested on known points."""
    k = F.col("s_suppkey")
    lat, lon = C.laea_to_wgs84(3_600_000 + k * 1000.0, 2_000_000 + k * 500.0)
    return table(spark, d, "supplier").select(k.alias("k"), lat.alias("lat"), lon.alias("lon"))


@query(
    "SELECT p_partkey AS k, (p_size + p_size % 3) / 2.0::DOUBLE AS residential_index, (p_size % 4 + p_size % 5) / 2.0::DOUBLE AS industrial_index, p_size % 6 * 1.0::DOUBLE AS height_index FROM part",
    "residential_index industrial_index height_index",
)
def composite_indices(spark, d):
    """C4."""
    s = F.col("p_size")
    raw = {c: F.lit(0.0) for parts in C.COMPOSITES.values() for c in parts} | {
        "building_area_residential": s, "n_dwellings": s % 3, "building_area_industrial": s % 4, "building_area_warehouse_parking": s % 5, "n_floors_above_ground": s % 6 * 1.0,
    }
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("k"), *[c.alias(f"{n}_percentile") for n, c in raw.items()])
    return C.composite_indices(rows).select("k", "residential_index", "industrial_index", "height_index")


@query("WITH m AS (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2002-06-01', INTERVAL 1 MONTH)) AS d) SELECT strftime(d, '%Y%m') AS month FROM m WHERE strftime(d, '%Y%m') NOT IN (SELECT DISTINCT strftime(l_shipdate, '%Y%m') FROM lineitem)")
def missing_months(spark, d):
    """S9."""
    return clean.missing_months(table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyyMM").alias("month")), "1995-01-01", "2002-06-01")


@query("SELECT strftime(d, '%Y%m') AS month FROM (SELECT unnest(generate_series(DATE '1990-01-01', DATE '1993-01-01', INTERVAL 1 MONTH)) AS d) WHERE strftime(d, '%Y%m') NOT IN (SELECT DISTINCT strftime(l_shipdate, '%Y%m') FROM lineitem)")
def missing_months_of_years(spark, d):
    """S9, years as bounds."""
    return clean.missing_months(table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyyMM").alias("month")), "1990", "1993")


@query("SELECT feature, CASE WHEN feature IN (SELECT DISTINCT p_type FROM part) THEN 'selected' ELSE 'missing' END AS status FROM (SELECT DISTINCT p_type AS feature FROM part WHERE p_size < 5 UNION SELECT 'NONE')")
def feature_diff(spark, d):
    """U3."""
    p = table(spark, d, "part")
    wanted = p.where("p_size < 5").select(F.col("p_type").alias("feature")).union(spark.createDataFrame([("NONE",)], "feature string"))
    return clean.feature_diff(wanted, p.select(F.col("p_type").alias("feature")))


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS n FROM lineitem) WHERE n = 1")
def dedupe_first(spark, d):
    """U2."""
    return clean.dedupe_first(table(spark, d, "lineitem"), ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("SELECT s_suppkey, s_nationkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_name IN ('NATION_3', 'NATION_7') AND s_suppkey % 2 = 0")
def filter_municipality(spark, d):
    """P7."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    stations = s.select("s_suppkey", "s_nationkey", F.col("n_name").alias("nom_municipi"), F.when(F.col("s_suppkey") % 2 == 0, "Operativa").otherwise("Baixa").alias("nom_estat_ema"))
    return clean.filter_municipality(stations, [" nation_3", "NÀTION_7"], True).select("s_suppkey", "s_nationkey")


@query("SELECT event_id, TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'bad' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS v FROM events WHERE event_id % 5 <> 0", "v")
def coerce_numeric(spark, d):
    """P3."""
    k = F.col("event_id")
    rows = table(spark, d, "events").select(k, F.when(k % 5 == 0, F.when(k % 2 == 0, "bad").otherwise("NaN")).otherwise(F.col("value").cast("string")).alias("v"))
    return clean.coerce_numeric(rows, ["v"], ["event_id"])


@query(f"WITH {STATIC} SELECT y, x, svf, 0.0::DOUBLE AS unknown FROM static", "svf")
def select_features(spark, d):
    """P16."""
    return clean.select_features(static(spark, d), ["svf", "unknown"], strict=False)


@query(f"WITH {STATIC} SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE avg_height END, (SELECT avg(avg_height) FROM static)) AS avg_height FROM static", "avg_height")
def neutral_fill(spark, d):
    """P14."""
    s = static(spark, d)
    rows = s.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.lit(None)).otherwise(F.col("avg_height")).alias("avg_height"))
    return clean.neutral_fill(rows, stats.norm_stats(s, ["avg_height"]), ["avg_height"])


@query("WITH f AS (SELECT o_orderdate AS t0, CAST(o_orderkey % 48 AS INT) AS step, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS v, o_custkey % 20 AS cell FROM orders), r AS (SELECT cell, t0 + to_hours(step) AS time, v, row_number() OVER (PARTITION BY cell, t0 + to_hours(step) ORDER BY t0, step) AS n FROM (SELECT cell, t0, step, max(v) AS v FROM f WHERE v IS NOT NULL GROUP BY 1, 2, 3)) SELECT cell, time, v FROM r WHERE n = 1")
def valid_time(spark, d):
    """P17."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("cell"), F.col("o_orderdate").cast("timestamp").alias("time"), (k % 48).cast("int").alias("step"), F.when(k % 9 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("v"))
    return clean.valid_time(rows.groupBy("cell", "time", "step").agg(F.max("v").alias("v")), ["v"])


@query(f"WITH {HOURLY} SELECT CAST(station_id AS DOUBLE) AS lat, 2.0::DOUBLE AS lon, time, obs_c AS temperature_2m FROM hourly", "temperature_2m")
def forecast_rows(spark, d):
    """Payloads with parallel arrays, made of the readings."""
    hours = hourly_of(spark, d).groupBy("station_id").agg(F.array_sort(F.collect_list(F.struct("time", "obs_c"))).alias("h"))
    part = lambda f: F.transform("h", lambda r: r[f])
    hourly = F.struct(part("time").alias("time"), part("obs_c").alias("temperature_2m"))
    return io.forecast_rows(hours.select(F.col("station_id").cast("double").alias("latitude"), F.lit(2.0).alias("longitude"), hourly.alias("hourly"))).select("lat", "lon", "time", "temperature_2m")


@query(f"WITH {GRID} SELECT time, y, x, t_c FROM grid WHERE time >= TIMESTAMP '1998-01-01' AND time < TIMESTAMP '1999-01-01'", "t_c")
def grid_cache(spark, d):
    """Written by date and read back, pruned."""
    path = io.scratch(spark, "grid")
    io.write_grid(grid(spark, d).select("time", "y", "x", "t_c"), path)
    return io.read_grid(spark, path, "1998-01-01", "1999-01-01").drop("date")
