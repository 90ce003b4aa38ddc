"""Hand-made frames: nulls, NaN, ties, gaps, wrapping hours, single rows, and helpers against brute force."""

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heatloom.functions import columns as C
from heatloom.operators import audit, clean, geostat, grids, heat, regions, report, sampling, stats, urban, verify
from heatloom.sources import io
from heatloom.streaming import alerts, state

T0 = datetime(2024, 7, 1)
NAN, INF = float("nan"), float("inf")


def hours(*values, start=T0):
    return [(start + timedelta(hours=k), v) for k, v in enumerate(values)]


def test_hour_window_wraps(spark):
    rows = spark.createDataFrame([(T0 + timedelta(hours=h),) for h in range(24)], "time timestamp")
    night = {r[0].hour for r in rows.where(C.hour_in_window(F.col("time"), 20, 6)).collect()}
    assert night == {20, 21, 22, 23, 0, 1, 2, 3, 4, 5, 6}


def test_alert_level_ladder(spark):
    rows = spark.createDataFrame([(x,) for x in (None, 0.0, 0.05, 0.0999, 0.10, 0.25, 1.0)], "f double")
    assert [r[0] for r in rows.select(C.alert_level(F.col("f"))).collect()] == ["normal", "normal", "watch", "watch", "warning", "severe", "severe"]


def test_names_and_index(spark):
    row = spark.createDataFrame([("pred_2024-07-01T10:00.npy", "41.2_2.1", "a_S7_x", " Barcelonès  Òdena ")], "n string, i string, e string, t string").select(
        C.parse_name_time(F.col("n")), *C.parse_index(F.col("i")), C.extract_seed(F.col("e")), C.norm_text(F.col("t"))
    ).first()
    assert list(row) == [datetime(2024, 7, 1, 10), 41.2, 2.1, 7, "barcelones odena"]


def test_laea_centre_and_corner(spark):
    rows = spark.createDataFrame([(4321000.0, 3210000.0), (3664000.0, 2066000.0)], "x double, y double")
    got = [tuple(r) for r in rows.select(*C.laea_to_wgs84(F.col("x"), F.col("y"))).collect()]
    assert got[0] == pytest.approx((52, 10), abs=1e-8)
    assert got[1][0] == pytest.approx(41.4, abs=0.3) and got[1][1] == pytest.approx(2.1, abs=0.3)


def test_coerce_and_kelvin(spark):
    rows = spark.createDataFrame([("1.5", "a"), ("x", "b"), ("NaN", "c"), (None, "d"), ("3", None)], "v string, k string")
    assert [r.v for r in clean.coerce_numeric(rows, ["v"], ["k"]).collect()] == [1.5]
    warm = spark.createDataFrame([(290.0,), (300.0,)], "v double")
    assert [r.v for r in clean.kelvin_guard(warm, "v").orderBy("v").collect()] == pytest.approx([16.85, 26.85])
    cool = spark.createDataFrame([(20.0,), (210.0,)], "v double")
    assert [r.v for r in clean.kelvin_guard(cool, "v").orderBy("v").collect()] == [20.0, 210.0]


def test_splits_are_half_open(spark):
    rows = spark.createDataFrame([(datetime(2017, 10, 31, 23),), (datetime(2017, 11, 1),), (datetime(2018, 1, 1),)], "time timestamp")
    bounds = [("train", "2017-01-01", "2017-11-01"), ("val", "2017-11-01", "2017-12-01"), ("test", "2017-12-01", "2018-01-01")]
    assert [r.split for r in clean.label_split(rows, bounds).orderBy("time").collect()] == ["train", "val", None]


def test_segments_cross_labels(spark):
    rows = spark.createDataFrame([(T0.replace(hour=9),), (T0.replace(hour=3),)], "time timestamp")
    got = clean.explode_segments(rows, rows.where("hour(time) = 3")).collect()
    assert {r.segment for r in got if r.time.hour == 9} == {"all", "day", "non_heatwave", "day_non_heatwave"}
    assert {r.segment for r in got if r.time.hour == 3} == {"all", "night", "heatwave", "night_heatwave"}


def test_features_strict_or_zero(spark):
    rows = spark.createDataFrame([(0, 0, 1.0)], "y int, x int, svf double")
    with pytest.raises(ValueError):
        clean.select_features(rows, ["svf", "ndvi"])
    assert clean.select_features(rows, ["svf", "ndvi"], strict=False).first().ndvi == 0.0


def test_valid_time_first_run_wins(spark):
    rows = spark.createDataFrame([(T0, 6, 1.0), (T0 + timedelta(hours=6), 0, 2.0), (T0, 7, None)], "time timestamp, step int, v double")
    got = clean.valid_time(rows, ["v"]).collect()
    assert [(r.time, r.v) for r in got] == [(T0 + timedelta(hours=6), 1.0)]


def test_hourly_mean_skips_bad_readings(spark):
    rows = [(T0, "a", 1.0), (T0 + timedelta(minutes=30), "a", 3.0), (T0, "a", NAN), (T0, "b", None), (T0, "b", INF)]
    got = heat.hourly_station_mean(spark.createDataFrame(rows, "time timestamp, station_id string, obs_c double")).collect()
    assert [(r.station_id, r.obs_c, r.n_obs_raw) for r in got] == [("a", 2.0, 2)]


def flags(spark, pattern, gap=None):
    rows = [(T0.date() + timedelta(days=k), int(c == "1")) for k, c in enumerate(pattern) if k != gap]
    return spark.createDataFrame(rows, "day date, flag int")


def test_runs_of_two_three_and_to_the_end(spark):
    got = heat.events_from_flags(flags(spark, "110111001111"), "flag").orderBy("event_id").collect()
    assert [(r.event_id, r.duration_days) for r in got] == [(1, 3), (2, 4)]


def test_missing_day_breaks_only_date_runs(spark):
    rows = flags(spark, "11111", gap=2)
    assert [r.duration_days for r in heat.events_from_flags(rows, "flag").collect()] == [4]
    assert heat.events_from_flags(rows, "flag", adjacency="date").count() == 0


def test_two_denominators(spark):
    pred = spark.createDataFrame([(T0, 0, 0, 31.0), (T0, 0, 1, NAN), (T0, 0, 2, 10.0), (T0, 0, 3, 10.0)], "time timestamp, y int, x int, pred_c double")
    thr = spark.createDataFrame([(0, x, 30.0) for x in range(4)], "y int, x int, thr double")
    got = heat.hourly_alerts(pred, thr).first()
    assert (got.exceed_fraction, got.total_cells, got.affected_cells, got.alert_level) == (0.25, 4, 1, "severe")
    tmax = spark.createDataFrame([("a", T0.date(), 31.0), ("b", T0.date(), None), ("c", T0.date(), 1.0)], "station_id string, day date, tmax double")
    limits = spark.createDataFrame([("a", 30.0), ("b", 30.0), ("c", 30.0)], "station_id string, thr double")
    assert heat.exceed_fraction(tmax, limits, ["station_id"]).first().exceed_fraction == 0.5


LEVELS = "n n w s n n n n n n n n n n n n n n w n n n n n n n n n n n n n n n w".split()
FULL = {"n": "normal", "w": "warning", "s": "severe"}


def level_rows(spark):
    rows = [("m", T0 + timedelta(hours=k), FULL[c], 20.0 + k, k / 100) for k, c in enumerate(LEVELS)]
    return spark.createDataFrame(rows, "model string, time timestamp, alert_level string, max_pred_c double, exceed_fraction double")


def test_cooldown_events_and_their_stream(spark):
    rows = level_rows(spark)
    got = heat.heat_events_cooldown(rows, ["model"]).orderBy("start").collect()
    assert [(r.start.hour, r.duration_hours, r.peak_level) for r in got] == [(2, 13.0, "severe"), (18, 12.0, "warning")]
    detector, event, out = state.HeatEvents(6, 12, 48 * state.HOUR), None, []
    for r in rows.orderBy("time").collect():
        event = detector.take(event, (int(r.time.timestamp() * 1_000_000), r.alert_level, r.max_pred_c, r.exceed_fraction), out)
    assert [(t[2] / 1e6, t[3] / 1e6, t[4]) for t in out if t[1] == "ended"] == [(r.start.timestamp(), r.end.timestamp(), r.peak_level) for r in got]
    assert [t[1] for t in out].count("started") == 3
    assert detector.take(None, (0, "watch", 1.0, 0.0), out) is None


def test_silence_ends_events(spark):
    """A gap of more than silence_h hours ends what is open, silence_h after the last row, and so does the end of the rows."""
    rows = [("m", T0, "severe", 30.0, 0.5), ("m", T0 + timedelta(hours=3), "normal", 20.0, 0.1), ("m", T0 + timedelta(hours=60), "warning", 25.0, 0.2)]
    df = spark.createDataFrame(rows, "model string, time timestamp, alert_level string, max_pred_c double, exceed_fraction double")
    got = heat.heat_events_cooldown(df, ["model"], silence_h=10).orderBy("start").collect()
    assert [(r.start, r.end) for r in got] == [(T0, T0 + timedelta(hours=13)), (T0 + timedelta(hours=60), T0 + timedelta(hours=70))]
    assert [r.peak_level for r in heat.heat_events_cooldown(df, ["model"]).collect()] == []


def test_short_event_is_discarded():
    detector, out = state.HeatEvents(6, 2, 48 * state.HOUR), []
    event = detector.take(None, (0, "warning", 1.0, 0.1), out)
    assert detector.take(event, (2 * state.HOUR, "normal", 1.0, 0.0), out) is None and out[-1][1] == "discarded"


def test_bilinear_needs_four_values(spark):
    """A station with an empty corner has no value, also where the corner's weight is 0."""
    lats, lons = (spark.createDataFrame([(0, 0.0), (1, 1.0)], "index int, value double") for _ in range(2))
    places = spark.createDataFrame([("a", 0.5, 0.5), ("b", 0.0, 0.0)], "station_id string, lat double, lon double")
    weights = grids.bilinear_weights(places, lats, lons)
    full = spark.createDataFrame([(y, x, 1.0 + 2 * y + x) for y in range(2) for x in range(2)], "y int, x int, v double")
    value = lambda f: {r.station_id: r.v for r in grids.weighted_extract(f, weights, "v", [], whole=True).collect()}
    assert value(full) == {"a": 2.5, "b": 1.0}
    assert value(full.where("y = 0 or x = 0")) == {"a": None, "b": None}
    nan = full.withColumn("v", F.when(F.col("y") + F.col("x") == 2, float("nan")).otherwise(F.col("v")))
    assert value(nan) == {"a": None, "b": None}


def test_hour_residuals(spark):
    """Night less day; R2 of the cells' mean absolute errors on their feature."""
    rows = [(h, 0, x, 10.0 + h + sign * (1 + x) * (h == 3), 10.0 + h, float(x)) for x in range(12) for h in (3, 14, 15) for sign in (1, -1)]
    df = spark.createDataFrame(rows, "hour int, y int, x int, pred_c double, t_c double, feature double")
    got = {r.hour: r for r in grids.hour_residuals(df).collect()}
    assert set(got) == {3, 14} and got[3].mae == pytest.approx(6.5) and got[3].r2 == pytest.approx(1.0) and got[14].mae == 0
    delta = grids.day_night_delta(grids.hour_residuals(df)).first()
    assert delta.delta_mae == pytest.approx(6.5) and delta.delta_ref_mean == pytest.approx(3 - 14)
    assert {r.hour: r.r2 for r in grids.hour_residuals(df.where("x < 9")).collect()} == {3: None, 14: None}
    assert grids.overall_residuals(df).first().bias == pytest.approx(0)


def test_day_night_delta_of_all_figures(spark):
    """Bias and R2 too: at night errors grow with the feature and are all positive; by day they have another sign and no line."""
    errors = {3: lambda x: 1.0 + x, 14: lambda x: -2.0 if x % 2 else -4.0}
    df = spark.createDataFrame([(h, 0, x, 20.0 + error(x), 20.0, float(x)) for h, error in errors.items() for x in range(12)], "hour int, y int, x int, pred_c double, t_c double, feature double")
    delta = grids.day_night_delta(grids.hour_residuals(df)).first()
    assert delta.delta_mae == pytest.approx(6.5 - 3) and delta.delta_bias == pytest.approx(6.5 + 3)
    r = np.corrcoef(range(12), [abs(errors[14](x)) for x in range(12)])[0, 1]
    assert delta.delta_r2 == pytest.approx(1 - r * r)


def test_dynamic_thresholds_need_rows(spark):
    rows = [(T0 + timedelta(days=k), 40.0 + k % 3) for k in range(30)] + [(T0 + timedelta(hours=5), 50.0)]
    got = {r.hour: r for r in heat.dynamic_thresholds(spark.createDataFrame(rows, "time timestamp, max double")).where("month = 7").collect()}
    assert got[5].severe == 36.0 and got[0].severe > 41 and got[0].normal == pytest.approx(np.quantile([40.0 + k % 3 for k in range(30)], 0.75) - 2)


def test_correlation_without_variance_is_null(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (NAN, 1.0)], "p double, o double")
    got = verify.verify(rows, "p", "o").first()
    assert got.Corr is None and got.N == 2 and got["MAE"] == 1.5
    assert verify.verify(rows.limit(1), "p", "o").first().Corr is None


def test_align_times_without_common_hours(spark):
    a = spark.createDataFrame([(T0,)], "time timestamp")
    with pytest.raises(ValueError):
        verify.align_times(a, a.where("false"))


def test_ranks_are_distinct_and_std_of_one_is_zero(spark):
    rows = spark.createDataFrame([("s", m, 1.0, 1.0, 0.5) for m in ("b", "a")], "segment string, model string, RMSE double, MAE double, Corr double")
    assert {r.model: r["rank"] for r in report.rank_models(rows, ["segment"], "narrative").collect()} == {"a": 1, "b": 2}
    raw = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0), ("b", NAN)], "model string, mae double")
    got = {r.model: r for r in report.aggregate_models(raw, ["model"], ["mae"]).collect()}
    assert got["a"].mae_std == 0.0 and got["b"].mae_std == pytest.approx(2**0.5) and got["b"].mae_mean == 2.0


def axis(spark, values):
    return spark.createDataFrame([(float(v), k) for k, v in enumerate(values)], "value double, index int")


def test_nearest_ties_and_bilinear_weights(spark):
    stations = spark.createDataFrame([("mid", 0.5, 1.5), ("out", -9.0, 99.0), ("on", 1.0, 1.0)], "station_id string, lat double, lon double")
    near = {r.station_id: (r.y, r.x) for r in grids.nearest_cell(stations, axis(spark, [0, 1, 2]), axis(spark, [2, 1, 0])).collect()}
    assert near["mid"] == (0, 0) and near["out"] == (0, 0)
    w = grids.bilinear_weights(stations, axis(spark, [0, 1, 2]), axis(spark, [2, 1, 0]))
    assert {round(r.s, 12) for r in w.groupBy("station_id").agg(F.sum("w").alias("s")).collect()} == {1.0}
    field = spark.createDataFrame([(y, x, 10.0 * y + (2 - x)) for y in range(3) for x in range(3)], "y int, x int, v double")
    got = {r.station_id: r.v for r in grids.weighted_extract(field, w, "v", []).collect()}
    assert got == pytest.approx({"mid": 6.5, "out": 2.0, "on": 11.0})


def test_idw_stays_between_stations(spark):
    obs = spark.createDataFrame([(T0, "a", 10.0), (T0, "b", 20.0)], "time timestamp, station_id string, obs_c double")
    st = spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.0, 1.0), ("c", 1.0, 1.0)], "station_id string, lat double, lon double")
    cells = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 0.0, 0.5), (1, 1, 1.0, 1.0)], "y int, x int, lat double, lon double")
    got = {(r.y, r.x): r.t_c for r in grids.idw(obs, st, cells, k=3).collect()}
    assert got[0, 0] == pytest.approx(10) and got[1, 1] == pytest.approx(15) and 10 < got[0, 1] < 20


def test_upsampled_and_mosaicked_constants(spark):
    lr = spark.createDataFrame([(0, y, x, 5.0) for y in range(3) for x in range(2)], "t int, gy int, gx int, v double")
    assert {round(r.v, 9) for r in grids.upsample(lr, (3, 2), (9, 8), ["t"], "v").collect()} == {5.0}
    corners = grids.tile_grid(spark.createDataFrame([(10, 7)], "h int, w int"), 4, 3)
    assert {r.y0 for r in corners.collect()} == {0, 3, 6} and {r.x0 for r in corners.collect()} == {0, 3}
    cell = F.explode(F.sequence(F.lit(0), F.lit(3)))
    tiles = corners.withColumn("dy", cell).withColumn("dx", cell).withColumns({"time": F.lit(1), "value": F.lit(2.5)})
    got = grids.mosaic(tiles, 4)
    assert got.count() == 70 and {round(r.value, 9) for r in got.collect()} == {2.5}


def test_fill_passes(spark):
    rows = [("v", T0, 0, x, v) for x, v in enumerate([None, 1.0, None, None, 5.0])] + [("v", T0, 1, x, NAN) for x in range(5)] + [("w", T0, 0, 0, None)]
    df = spark.createDataFrame(rows, "variable string, time timestamp, y int, x int, value double")
    got = {(r.variable, r.y, r.x): r.value for r in grids.fill_grid(df, "value").collect()}
    assert [got["v", 0, x] for x in range(5)] == [1, 1, 1, 5, 5] and [got["v", 1, x] for x in range(5)] == [1, 1, 1, 5, 5] and got["w", 0, 0] == 0
    tie = spark.createDataFrame([(0, x, v) for x, v in enumerate([1.0, None, 5.0])], "y int, x int, value double")
    assert grids.nearest_fill(tie, "value", "x", ["y"]).where("x = 1").first().value == 1.0


def test_repair_uses_time_then_space(spark):
    frame = lambda t, bad: [(y, x, T0 + timedelta(hours=t), NAN if bad and (y, x) == (1, 1) else 10.0 + t) for y in range(4) for x in range(4)]
    df = spark.createDataFrame(frame(0, False) + frame(1, True) + frame(2, False) + frame(3, True), "y int, x int, time timestamp, value double")
    got = {(r.time.hour, r.repaired_by): r.value for r in grids.repair_nan(df).where("y = 1 and x = 1").collect()}
    assert got[1, "time"] == 11.0 and 0 < got[3, "space"] < 13
    assert grids.repair_nan(df).count() == 64


def test_ssim_bounds():
    a = np.random.default_rng(1).normal(size=(16, 16))
    assert grids.ssim_value(a, a) == pytest.approx(1)
    assert grids.ssim_value(-a, a) < 0.5 and grids.ssim_value(a, np.ones((16, 16))) is None and grids.ssim_value(a[:5], a[:5]) is None


def test_asof_takes_next_or_last(spark):
    times = spark.createDataFrame([(T0,), (T0 + timedelta(hours=3),)], "time timestamp")
    req = spark.createDataFrame([(T0,), (T0 + timedelta(hours=1),), (T0 + timedelta(hours=9),)], "req timestamp")
    assert [r.time.hour for r in grids.asof_next(times, req).orderBy("req").collect()] == [0, 3, 3]


def test_vif_and_scaling(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    x[:, 2] = x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.normal(size=300)
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")))
    for r in stats.vif(df, list("abc")).collect():
        k = "abc".index(r.variable)
        others = np.column_stack([np.ones(300), np.delete(x, k, 1)])
        resid = x[:, k] - others @ np.linalg.lstsq(others, x[:, k], rcond=None)[0]
        assert r.vif == pytest.approx(x[:, k].var() / resid.var(), rel=1e-6)
    assert {r.vif for r in stats.vif(df.limit(6), list("abc")).collect()} == {None}
    flat = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert {r.v for r in stats.robust_scale(flat, ["v"]).collect()} == {0.0}


def test_repair_goes_on_from_repaired_frames(spark):
    """Two bad frames in a row: the first has no good frame after it, so space; the second takes the mean of that repaired frame and the next."""
    good = lambda t: np.add.outer(np.arange(4.0), np.arange(5.0)) + t
    frames = [good(t) for t in range(7)]
    holes = {0: [(2, 2)], 2: [(1, 1), (0, 3)], 3: [(1, 1)], 5: [(3, 3)], 6: [(3, 3), (0, 0)]}
    for t, cells in holes.items():
        for c in cells:
            frames[t][c] = np.nan
    kernel = grids.gaussian_kernel(1.0, 4)
    want, by = [f.copy() for f in frames], {}
    for t, f in enumerate(want):
        bad = ~np.isfinite(f)
        for c in zip(*np.nonzero(bad), strict=True):
            if 0 < t < 6 and np.isfinite(want[t - 1][c]) and np.isfinite(frames[t + 1][c]):
                f[c], by[t, *c] = (want[t - 1][c] + frames[t + 1][c]) / 2, "time"
        left = ~np.isfinite(f)
        f[left] = grids.smooth(np.nan_to_num(f), kernel)[left]
        by |= {(t, *c): by.get((t, *c), "space") for c in zip(*np.nonzero(bad), strict=True)}
    rows = [(y, x, T0 + timedelta(hours=t), float(frames[t][y, x])) for t in range(7) for y in range(4) for x in range(5)]
    got = grids.repair_nan(spark.createDataFrame(rows, "y int, x int, time timestamp, value double")).collect()
    assert len(got) == len(rows) and by[3, 1, 1] == "time" and by[2, 1, 1] == "space"
    for r in got:
        assert r.value == pytest.approx(want[r.time.hour][r.y, r.x]) and r.repaired_by == by.get((r.time.hour, r.y, r.x), "none")


def test_variograms_agree_on_a_lattice(spark):
    rng = np.random.default_rng(2)
    xy = np.array([(i, j) for i in range(8) for j in range(8)], float)
    v = rng.normal(size=64)
    df = spark.createDataFrame([(k, *map(float, p), float(z)) for k, (p, z) in enumerate(zip(xy, v, strict=True))], "id int, x double, y double, value double")
    table = geostat.variogram(df).orderBy("bin").toPandas()
    lag, semi = geostat.empirical(xy, v)
    assert np.allclose(table.lag, lag) and np.allclose(table.semivariance, semi)
    i, j = np.triu_indices(64, 1)
    d = np.sqrt(((xy[i] - xy[j]) ** 2).sum(1))
    which = np.digitize(d, np.linspace(0, d.max() / 2, 16)) - 1
    assert np.allclose(lag, [d[which == b].mean() for b in range(15) if (which == b).sum() >= 10])


def test_names_are_decomposed(spark):
    row = spark.createDataFrame([("\tÇa  d'Œuvre ő ŀ ﬁ \n", None, "")], "a string, b string, c string").select(*[C.norm_text(F.col(c)) for c in "abc"]).first()
    assert list(row) == ["ca d'œuvre o l· fi", None, ""]


def test_noise_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(k, "v", 1.0) for k in range(2_000)], "y int, variable string, value double")
    one, two = (sorted(map(tuple, sampling.perturb(df.repartition(n), "v", [0.5], 2, 3).collect())) for n in (1, 5))
    values = np.array([r[2] for r in one])
    assert one == two and abs(values.mean() - 1) < 0.05 and abs(values.std() - 0.5) < 0.03


def test_draws_are_never_lost(spark):
    """Weights whose sum falls short of 1, and one row that spans most parts."""
    cdf = sampling.weights_cdf(spark.createDataFrame([(k, 0.9 if k == 3 else 0.001) for k in range(50)], "k int, weight double"), ["k"])
    assert sampling.sample_times(cdf, 5_000, 1).count() == 5_000


def test_peak_day_is_that_of_the_largest_exceedance(spark):
    day = lambda k: (T0 + timedelta(days=k)).date()
    rows = [(day(0), 1, "warning", 0.9, 30.0, 1.0), (day(1), 1, "severe", 0.2, 31.0, 4.0), (day(2), 1, "warning", 0.3, 35.0, 4.0), (day(3), 1, "warning", 0.1, 20.0, None), (day(4), 0, "normal", 0.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "day date, flag int, alert_level string, exceed_fraction double, max_pred_c double, max_exceedance_c double")
    r = heat.events_from_flags(df, "flag", extra=heat.heat_peaks()).first()
    assert (r.peak_date, r.peak_alert_level, r.peak_max_exceedance_c, r.peak_max_pred_c, r.peak_exceed_fraction) == (day(1), "severe", 4.0, 35.0, 0.9)


def test_bootstrap_repeats_and_holds_the_mean(spark):
    raw = spark.createDataFrame([("a", float(k), 1.0) for k in range(20)] + [("b", 3.0, 1.0)], "model string, mae double, ssim double")
    one, two = (sorted(map(tuple, stats.bootstrap_mean_ci(raw.repartition(n), ["model"], ["mae"], 300).collect())) for n in (1, 3))
    assert one == two
    low = {r[0]: r for r in one}
    assert low["a"][4] < 9.5 < low["a"][5] and low["b"][3:] == (3.0, 3.0, 3.0)
    d = stats.bootstrap_delta_ci(raw, "b", ["mae"], 300).first()
    assert d.model == "a" and d.delta == pytest.approx(3 - 9.5) and d.low < d.delta < d.high


def test_gaps_and_even_sample(spark):
    times = spark.createDataFrame([(T0 + timedelta(hours=h),) for h in (0, 1, 1, 2, 6)], "time timestamp")
    assert [(r.gap_from.hour, r.hours) for r in audit.time_gaps(times).collect()] == [(2, 4.0)]
    assert sorted(r.time.hour for r in audit.even_sample(times, 2).collect()) == [0, 6]
    assert audit.even_sample(times, 50).count() == 4


def test_sequences_skip_the_last_window(spark):
    df = spark.createDataFrame([(t, float(v)) for t, v in hours(*range(8))], "time timestamp, value double")
    assert [list(r["values"]) for r in sampling.sequences(df, 3, 2).orderBy("start").collect()] == [[0, 1, 2], [2, 3, 4], [4, 5, 6]]
    assert sampling.sequences(df, 3, 1, include_last=True).count() == 6


def test_weighted_draws_follow_weights(spark):
    df = spark.createDataFrame([(t, v) for t, v in hours(1.0, 1.0, 9.0, 9.0)], "time timestamp, value double")
    w = sampling.temporal_weights(df)
    assert w.agg(F.sum("weight")).first()[0] == pytest.approx(1)
    drawn = sampling.sample_times(sampling.weights_cdf(w, ["time"]), 500, 3)
    assert drawn.count() == 500 and drawn.where("hour(time) = 2").count() > 495
    tiles = sampling.sample_tiles(sampling.weights_cdf(spark.range(100).select((F.col("id") / 10).cast("int").alias("y"), (F.col("id") % 10).cast("int").alias("x"), F.lit(0.01).alias("weight")), ["y", "x"]), 200, (10, 10), 4)
    assert tiles.where("y0 between 0 and 6 and x0 between 0 and 6").count() == 200


def test_disc_areas():
    square = lambda a: [(-a, -a), (a, -a), (a, a), (-a, a)]
    assert urban.disc_polygon_area(square(10), (0, 0), 2) == pytest.approx(math.pi * 4)
    assert urban.disc_polygon_area(square(1), (0, 0), 9) == pytest.approx(4)
    assert urban.disc_polygon_area([(0, -9), (9, -9), (9, 9), (0, 9)], (0, 0), 2) == pytest.approx(math.pi * 2)
    assert urban.disc_polygon_area(square(1), (99, 0), 2) == pytest.approx(0, abs=1e-9)
    rng, ring = np.random.default_rng(4), np.array([(-1, -2), (3, -1), (2, 2), (-2, 1)])
    p = rng.uniform(-3, 3, (200_000, 2))
    inside = np.ones(len(p), bool)
    for a, b in zip(ring, np.roll(ring, -1, 0), strict=True):
        inside &= (b[0] - a[0]) * (p[:, 1] - a[1]) - (b[1] - a[1]) * (p[:, 0] - a[0]) >= 0
    inside &= ((p - (0.5, 0.2)) ** 2).sum(1) <= 1.8**2
    assert urban.disc_polygon_area(ring, (0.5, 0.2), 1.8) == pytest.approx(36 * inside.mean(), rel=0.02)


def test_buildings_meet_once(spark):
    ring = lambda x, y, s: [{"x": x, "y": y}, {"x": x + s, "y": y}, {"x": x + s, "y": y + s}, {"x": x, "y": y + s}]
    b = spark.createDataFrame([(1, 10.0, 3, ring(-500.0, -500.0, 1000.0)), (2, 20.0, 6, ring(290.0, 290.0, 20.0)), (3, 1.0, 1, ring(5000.0, 0.0, 9.0))], "id long, height_m double, levels int, ring array<struct<x: double, y: double>>")
    s = spark.createDataFrame([("a", 300.0, 300.0), ("z", -9000.0, 0.0)], "station_id string, x double, y double")
    hits = urban.buffer_intersect(s, b)
    assert sorted(r.id for r in hits.collect()) == [1, 2]
    got = {r.station_id: r for r in urban.urban_metrics(hits, s).collect()}
    assert got["a"].buildings_in_buffer == 2 and got["a"].max_levels == 6 and got["z"].total_built == 0


def test_kriging_is_exact_at_points():
    rng = np.random.default_rng(6)
    xy = rng.uniform(0, 5, (120, 2))
    v = np.sin(xy[:, 0]) + np.cos(xy[:, 1])
    model = geostat.fit_spherical(*geostat.empirical(xy, v))
    near = regions.k_nearest(((xy[:20, None] - xy[None]) ** 2).sum(-1), 48)
    assert geostat.krige(xy[:20], xy[near], v[near], np.tile(model, (20, 1))) == pytest.approx(v[:20], abs=1e-4)
    lag = np.linspace(0.2, 4, 12)
    assert geostat.fit_spherical(lag, geostat.spherical(lag, 0.0, 2.0, lag[-1])) == pytest.approx((0, 2, lag[-1]), abs=1e-6)
    assert geostat.fit_spherical(lag[:3], lag[:3]) is None


def test_pooling_and_block_folds(spark):
    rows = spark.createDataFrame([(k, k % 10, float(k % 7), float(k % 5), 1.0) for k in range(100)] + [(100, 99, 0.0, 0.0, 1.0)], "id long, cls int, x double, y double, value double")
    assert geostat.pool_rare_classes(rows, "cls", 5).where("cls = -1").count() == 1
    assert {r.fold for r in geostat.block_folds(rows).collect()} == {0, 1, 2, 3}


def test_sources(spark, tmp_path):
    (tmp_path / "obs.csv").write_text("time,station_id,lat,lon,t2m_c\n2024-07-01 10:00:00,7,41.1,2.1,20.5\nbad,7,41.1,2.1,1\n2024-07-01 11:00:00,7,41.1,2.1,NaN\n")
    assert [tuple(r) for r in io.read_station_obs(spark, str(tmp_path / "obs.csv")).collect()] == [(datetime(2024, 7, 1, 10), "7", 41.1, 2.1, 20.5)]
    (tmp_path / "bad.csv").write_text("time,station_id\n")
    with pytest.raises(ValueError):
        io.read_station_obs(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "f.json").write_text('[{"latitude": 41.2, "longitude": 2.0, "hourly": {"time": ["2024-07-01T00:00", "2024-07-01T01:00"], "temperature_2m": [20.0, null]}}]')
    got = io.read_forecast_json(spark, str(tmp_path / "f.json")).orderBy("time").collect()
    assert [(r.time.hour, r.temperature_2m, r.precipitation) for r in got] == [(0, 20.0, None), (1, None, None)]
    maps = tmp_path / "maps"
    maps.mkdir()
    np.save(maps / "p_2024_07_01_10_00.npy", np.arange(6.0).reshape(2, 3))
    np.save(maps / "p_2024_07_01_11_00_00.npy", np.arange(6.0).reshape(2, 3, 1))
    np.save(maps / "nothing.npy", np.zeros((9, 9)))
    got = io.read_prediction_maps(spark, str(maps), model="m")
    assert got.count() == 12 and got.where("y = 1 and x = 2").agg(F.sum("pred_c")).first()[0] == 10.0
    np.save(maps / "p_2024_07_01_12_00.npy", np.zeros((4, 4)))
    with pytest.raises(Exception, match="different shapes"):
        io.read_prediction_maps(spark, str(maps)).count()
    (tmp_path / "manifest.csv").write_text("time,path\n2024-07-01 11:00:00,b.npy\n2024-07-01 10:00:00,/abs/a.npy\n")
    assert [r.path for r in io.read_manifest(spark, str(tmp_path / "manifest.csv"), "/root").collect()] == ["/abs/a.npy", "/root/b.npy"]
    (tmp_path / "times.txt").write_text("# note\n\n2024-07-01 10:20:00\n2024-07-01 10:40:00\n")
    assert [r.time.hour for r in io.read_timestamps(spark, str(tmp_path / "times.txt")).collect()] == [10]
    header = "experiment,model,mae,rmse,ssim,patch_size,stride,seq_len,temporal_stride,time_index,time,scale_from,pct_low,pct_high,vmin,vmax"
    for n in "ab":
        (tmp_path / f"{n}_metrics.csv").write_text(f"{header}\ne,ConvLSTM,1,2,0.5,96,48,6,1,0,2024-07-01 10:00:00,hr,2,98,1,9\n")
    assert [(r.model, r.mae) for r in io.read_metrics(spark, str(tmp_path / "*_metrics.csv")).collect()] == [("lstm", 1.0)] * 2


def test_alert_files(spark, tmp_path):
    one = spark.createDataFrame([(T0, "watch")], "time timestamp, alert_level string")
    io.write_alerts(one, one, one, one, str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "hourly")).first().alert_level == "watch"
    assert spark.read.json(str(tmp_path / "summary")).columns == ["alert_level", "time"]


def test_late_readings_are_dropped_by_the_stream(spark, tmp_path):
    source, schema = tmp_path / "in", "time timestamp, station_id string, obs_c double"
    parts = [[(T0, "a", 1.0), (T0 + timedelta(hours=9), "a", 2.0)], [(T0 + timedelta(minutes=5), "a", 99.0), (T0 + timedelta(hours=20), "a", 3.0)], [(T0 + timedelta(hours=40), "a", 4.0)]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        out = alerts.drain(alerts.stream_station_hourly(spark.readStream.schema(schema).parquet(str(source)), "2 hours"), str(tmp_path / "out"), str(tmp_path / "check"), "update")
    got = {r.time: (r.obs_c, r.n_obs_raw) for r in heat.latest(out, ["station_id", "time"], "batch").collect()}
    assert got[T0] == (1.0, 1) and got[T0 + timedelta(hours=20)] == (3.0, 1)
