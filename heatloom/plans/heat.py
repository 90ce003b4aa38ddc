"""Queries: readings to hours, thresholds, exceedance, alerts and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatloom.functions import columns as C
from heatloom.operators import clean, heat
from heatloom.plans.base import GRID, HOURLY, OBS, THR, TMAX, grid, obs, query, table

LEVEL = "CASE WHEN exceed_fraction >= 0.25 THEN 'severe' WHEN exceed_fraction >= 0.10 THEN 'warning' WHEN exceed_fraction >= 0.05 THEN 'watch' ELSE 'normal' END"


def hourly_of(spark, d):
    return heat.hourly_station_mean(obs(spark, d))


def tmax_of(spark, d):
    return heat.daily_tmax(hourly_of(spark, d), ["station_id"], "obs_c")


def thr_of(spark, d):
    return heat.percentile_threshold(tmax_of(spark, d), ["station_id"])


@query(f"WITH {HOURLY} SELECT * FROM hourly", "obs_c")
def hourly_station_mean(spark, d):
    """P1, A1, ST3's batch twin."""
    return hourly_of(spark, d)


@query(f"WITH {HOURLY} SELECT station_id, count(obs_c) AS hours_with_data, avg(obs_c) AS mean_c FROM hourly GROUP BY 1", "mean_c")
def station_coverage(spark, d):
    return heat.station_coverage(hourly_of(spark, d))


@query(f"WITH {HOURLY} SELECT station_id, CAST(time + INTERVAL 2 HOUR AS DATE) AS day, max(obs_c) AS tmax FROM hourly GROUP BY 1, 2", "tmax")
def daily_tmax(spark, d):
    return heat.daily_tmax(hourly_of(spark, d), ["station_id"], "obs_c", offset_h=2)


@query(f"WITH {TMAX} SELECT s.station_id, d.day, t.tmax FROM (SELECT DISTINCT station_id FROM tmax) s CROSS JOIN (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM tmax) d LEFT JOIN tmax t ON t.station_id = s.station_id AND t.day = d.day", "tmax")
def daily_tmax_full(spark, d):
    return heat.daily_tmax(hourly_of(spark, d), ["station_id"], "obs_c", full_days=True)


@query(f"WITH {THR} SELECT * FROM thr", "thr")
def percentile_threshold(spark, d):
    return thr_of(spark, d)


DAY_MAX = "cell_days AS (SELECT l_suppkey AS cell, CAST(l_shipdate AS DATE) AS day, max(l_quantity * (1 + l_tax - l_discount)) AS tmax FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {DAY_MAX} SELECT cell, quantile_cont(tmax, 0.95) AS thr FROM cell_days WHERE month(day) IN (7, 8) AND day < DATE '2001-01-01' GROUP BY 1", "thr")
def percentile_threshold_cells(spark, d):
    """A4 over several years' July and August before the target year."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("cell"), F.col("l_shipdate").alias("time"), (F.col("l_quantity") * (1 + F.col("l_tax") - F.col("l_discount"))).alias("v"))
    return heat.percentile_threshold(heat.daily_tmax(rows, ["cell"], "v"), ["cell"], months=[7, 8], before="2001-01-01")


EXCEED = THR + ", daily AS (SELECT day, avg(CAST(tmax > thr AS DOUBLE)) AS exceed_fraction FROM tmax JOIN thr USING (station_id) GROUP BY 1), flagged AS (SELECT day, exceed_fraction, CAST(exceed_fraction >= 0.05 AS INT) AS is_heatwave_day FROM daily)"


def flagged_of(spark, d):
    return heat.exceed_fraction(tmax_of(spark, d), thr_of(spark, d), ["station_id"], least=0.05)


@query(f"WITH {EXCEED} SELECT * FROM flagged", "exceed_fraction")
def exceed_fraction(spark, d):
    return flagged_of(spark, d)


RUN_ISLANDS = ", f AS (SELECT *, {n} AS n FROM flagged), hot AS (SELECT *, n - row_number() OVER (ORDER BY day) AS run FROM f WHERE is_heatwave_day = 1), ev AS (SELECT min(day) AS start_date, max(day) AS end_date, count(*) AS duration_days, max(exceed_fraction) AS peak_exceed_fraction, avg(exceed_fraction) AS mean_exceed_fraction, arg_min(day, -exceed_fraction * 1000000 + date_diff('day', DATE '2000-01-01', day) / 1000000.0) AS peak_date FROM hot GROUP BY run HAVING count(*) >= 2), events_ AS (SELECT *, row_number() OVER (ORDER BY start_date) AS event_id FROM ev)"
PEAKS = {"peak_exceed_fraction": F.max, "mean_exceed_fraction": F.avg}


def events_of(spark, d, adjacency="row"):
    extra = {k: f("exceed_fraction") for k, f in PEAKS.items()} | {"peak_date": F.min_by("day", F.struct(-F.col("exceed_fraction"), F.col("day")))}
    return heat.events_from_flags(flagged_of(spark, d), "is_heatwave_day", min_days=2, adjacency=adjacency, extra=extra)


@query(f"WITH {EXCEED}{RUN_ISLANDS.format(n='row_number() OVER (ORDER BY day)')} SELECT * FROM events_", "peak_exceed_fraction mean_exceed_fraction")
def heat_events(spark, d):
    """The flagship: hours, daily maxima, thresholds, exceedance, runs."""
    return events_of(spark, d)


@query(f"WITH {EXCEED}{RUN_ISLANDS.format(n=chr(39).join(['date_diff(', 'day', ', DATE ', '1970-01-01', ', day)']))} SELECT * FROM events_", "peak_exceed_fraction mean_exceed_fraction")
def heat_events_by_date(spark, d):
    return events_of(spark, d, "date")


@query(f"WITH {EXCEED}{RUN_ISLANDS.format(n='row_number() OVER (ORDER BY day)')} SELECT d.day, d.is_heatwave_day, e.event_id FROM flagged d LEFT JOIN events_ e ON d.day BETWEEN e.start_date AND e.end_date")
def in_event(spark, d):
    return heat.in_event(flagged_of(spark, d).select("day", "is_heatwave_day"), events_of(spark, d))


@query(f"WITH {EXCEED}{RUN_ISLANDS.format(n='row_number() OVER (ORDER BY day)')} SELECT event_id, unnest(generate_series(CAST(start_date AS TIMESTAMP), CAST(end_date AS TIMESTAMP) + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS time FROM events_")
def event_hours(spark, d):
    return heat.event_hours(events_of(spark, d))


GRID_THR = GRID + ", thr AS (SELECT y, x, quantile_cont(t_c, 0.9) AS thr FROM grid GROUP BY 1, 2)"
FIGURES = "avg(CAST(v > thr AS DOUBLE)) AS exceed_fraction, sum(CAST(v > thr AS BIGINT))::BIGINT AS affected_cells, count(*) AS total_cells, avg(v) AS mean_pred_c, max(v) AS max_pred_c, avg(greatest(v - thr, 0)) AS mean_exceedance_c, max(v - thr) AS max_exceedance_c"
FIGURE_NAMES = "exceed_fraction mean_pred_c max_pred_c mean_exceedance_c max_exceedance_c"
ALERT_HOURLY = f"{GRID_THR}, h AS (SELECT time, {FIGURES} FROM (SELECT *, pred_c AS v FROM grid JOIN thr USING (y, x)) GROUP BY 1), alerts AS (SELECT *, {LEVEL} AS alert_level FROM h)"
ALERT_DAILY = f"{ALERT_HOURLY}, dm AS (SELECT y, x, CAST(time AS DATE) AS day, max(pred_c) AS v FROM grid GROUP BY 1, 2, 3), dd AS (SELECT day, {FIGURES} FROM dm JOIN thr USING (y, x) GROUP BY 1), days AS (SELECT *, {LEVEL} AS alert_level FROM dd)"


def alert_grid(spark, d):
    """The grid with exact means: whether a value that ties with its threshold is over it doesn't depend on the rows' order."""
    return grid(spark, d, C.exact_mean)


def grid_thr(spark, d):
    return alert_grid(spark, d).groupBy("y", "x").agg(F.percentile("t_c", 0.9).alias("thr"))


def alerts_of(spark, d):
    return heat.hourly_alerts(alert_grid(spark, d), grid_thr(spark, d))


def days_of(spark, d):
    return heat.daily_alerts(alert_grid(spark, d), grid_thr(spark, d))


@query(f"WITH {ALERT_HOURLY} SELECT * FROM alerts", FIGURE_NAMES)
def hourly_alerts(spark, d):
    """A6, P18; ST1's batch twin."""
    return alerts_of(spark, d)


@query(f"WITH {ALERT_DAILY} SELECT * FROM days", FIGURE_NAMES)
def daily_alerts(spark, d):
    """A7; ST2's batch twin."""
    return days_of(spark, d)


ALERT_EVENTS = ALERT_DAILY + """, fl AS (SELECT *, row_number() OVER (ORDER BY day) AS n, CASE alert_level WHEN 'severe' THEN 3 WHEN 'warning' THEN 2 WHEN 'watch' THEN 1 ELSE 0 END AS rk FROM days),
ho AS (SELECT *, n - row_number() OVER (ORDER BY day) AS run FROM fl WHERE rk >= 2),
ae AS (SELECT min(day) AS start_date, max(day) AS end_date, count(*) AS duration_days, max(rk) AS rk, max(exceed_fraction) AS peak_exceed_fraction, max(max_pred_c) AS peak_max_pred_c, max(max_exceedance_c) AS peak_max_exceedance_c, (list(day ORDER BY max_exceedance_c DESC NULLS LAST, day))[1] AS peak_date FROM ho GROUP BY run HAVING count(*) >= 2),
aev AS (SELECT start_date, end_date, duration_days, CASE rk WHEN 3 THEN 'severe' ELSE 'warning' END AS peak_alert_level, peak_exceed_fraction, peak_max_pred_c, peak_max_exceedance_c, peak_date, row_number() OVER (ORDER BY start_date) AS event_id FROM ae)"""


def alert_events_of(spark, d):
    flagged = days_of(spark, d).withColumn("flag", (C.level_rank(F.col("alert_level")) >= 2).cast("int"))
    peaks = heat.heat_peaks()
    return heat.events_from_flags(flagged, "flag", min_days=2, extra={k: peaks[k] for k in ("peak_date", "peak_alert_level", "peak_exceed_fraction", "peak_max_pred_c", "peak_max_exceedance_c")})


@query(f"WITH {ALERT_EVENTS} SELECT * FROM aev", "peak_exceed_fraction peak_max_pred_c peak_max_exceedance_c")
def alert_events(spark, d):
    return alert_events_of(spark, d)


@query(
    f"""WITH {ALERT_EVENTS}, hr AS (SELECT *, CASE alert_level WHEN 'severe' THEN 3 WHEN 'warning' THEN 2 WHEN 'watch' THEN 1 ELSE 0 END AS rk FROM alerts)
SELECT count(*) AS n_hours, min(time) AS first_time, max(time) AS last_time, arg_max(alert_level, rk) AS highest_level, arg_max(alert_level, time) AS latest_level, arg_max(exceed_fraction, time) AS latest_fraction,
(SELECT count(*) FROM days) AS n_days, (SELECT count(*) FROM aev) AS n_events, coalesce((SELECT bool_or(CAST(t AS DATE) BETWEEN start_date AND end_date) FROM aev, (SELECT max(time) AS t FROM alerts)), false) AS is_active_heatwave_event FROM hr""",
    "latest_fraction",
)
def alert_summary(spark, d):
    """A32, T1."""
    return heat.alert_summary(alerts_of(spark, d), days_of(spark, d), alert_events_of(spark, d))


@query(f"WITH {OBS} SELECT station_id, arg_max(obs_c, time) AS obs_c, max(time) AS time FROM obs GROUP BY 1")
def latest_reading(spark, d):
    return heat.latest(obs(spark, d).select("station_id", "time", "obs_c"), ["station_id"])


@query(f"WITH {ALERT_HOURLY} SELECT CAST(to_json({{'alert_level': alert_level, 'total_cells': total_cells}}) AS VARCHAR) AS payload, time FROM alerts")
def alert_json(spark, d):
    return alerts_of(spark, d).select(C.to_sorted_json(["total_cells", "alert_level"]).alias("payload"), "time")


COOL = HOURLY + """, lv AS (SELECT station_id, time, CASE WHEN obs_c >= 70 THEN 'severe' WHEN obs_c >= 45 THEN 'warning' WHEN obs_c >= 30 THEN 'watch' ELSE 'normal' END AS alert_level, obs_c AS max_pred_c, obs_c / 500 AS exceed_fraction FROM hourly),
c1 AS (SELECT *, alert_level IN ('warning', 'severe') AS hot, max(CASE WHEN alert_level IN ('warning', 'severe') THEN time END) OVER (PARTITION BY station_id ORDER BY time) AS last_hot FROM lv),
c2 AS (SELECT *, coalesce(NOT hot AND time - last_hot >= INTERVAL 12 HOUR, false) AS closes FROM c1),
c3 AS (SELECT *, coalesce(sum(CAST(closes AS INT)) OVER (PARTITION BY station_id ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM c2),
c4 AS (SELECT station_id, k, min(CASE WHEN hot THEN time END) AS start, max(CASE WHEN closes THEN time END) AS "end", max(CASE WHEN alert_level = 'severe' THEN 2 WHEN hot THEN 1 END) AS rk, max(CASE WHEN hot THEN max_pred_c END) AS peak_temp, max(CASE WHEN hot THEN exceed_fraction END) AS peak_area FROM c3 GROUP BY 1, 2),
c5 AS (SELECT station_id, start, "end", CASE rk WHEN 2 THEN 'severe' ELSE 'warning' END AS peak_level, peak_temp, peak_area, date_diff('second', start, "end") / 3600.0 AS duration_hours FROM c4 WHERE start IS NOT NULL AND "end" IS NOT NULL)"""


def levels_of(spark, d):
    v = F.col("obs_c")
    level = F.when(v >= 70, "severe").when(v >= 45, "warning").when(v >= 30, "watch").otherwise("normal")
    return hourly_of(spark, d).select("station_id", "time", level.alias("alert_level"), v.alias("max_pred_c"), (v / 500).alias("exceed_fraction"))


@query(f"WITH {COOL} SELECT * FROM c5 WHERE duration_hours >= 6", "peak_temp peak_area duration_hours")
def heat_events_cooldown(spark, d):
    """W12; ST6's batch twin."""
    return heat.heat_events_cooldown(levels_of(spark, d), ["station_id"])


@query(
    f"""WITH {HOURLY}, h AS (SELECT time, max(obs_c) AS m FROM hourly GROUP BY 1) SELECT CAST(month(time) AS INT) AS month, CAST(hour(time) AS INT) AS hour, count(*) AS n,
CASE WHEN count(*) < 24 THEN 28.0 ELSE greatest(28.0, quantile_cont(m, 0.75) - 2) END AS normal, CASE WHEN count(*) < 24 THEN 30.0 ELSE greatest(30.0, quantile_cont(m, 0.90) - 1) END AS watch,
CASE WHEN count(*) < 24 THEN 33.0 ELSE greatest(33.0, quantile_cont(m, 0.95)) END AS warning, CASE WHEN count(*) < 24 THEN 36.0 ELSE greatest(36.0, quantile_cont(m, 0.99)) END AS severe FROM h GROUP BY 1, 2""",
    "normal watch warning severe",
)
def dynamic_thresholds(spark, d):
    """ST7's static side."""
    hours = hourly_of(spark, d).groupBy("time").agg(F.max("obs_c").alias("max"))
    return heat.dynamic_thresholds(hours).withColumns({k: F.col(k).cast("double") for k in heat.BASE})


@query(f"WITH {HOURLY}, s AS (SELECT time, obs_c, unnest(['all', CASE WHEN hour(time) BETWEEN 8 AND 19 THEN 'day' ELSE 'night' END, CASE WHEN h.t IS NOT NULL THEN 'heatwave' ELSE 'non_heatwave' END, CASE WHEN hour(time) BETWEEN 8 AND 19 THEN 'day' ELSE 'night' END || '_' || CASE WHEN h.t IS NOT NULL THEN 'heatwave' ELSE 'non_heatwave' END]) AS segment FROM hourly LEFT JOIN (SELECT DISTINCT time AS t FROM hourly WHERE obs_c > 150) h ON h.t = time) SELECT segment, count(*) AS n, avg(obs_c) AS mean_c FROM s GROUP BY 1", "mean_c")
def segments(spark, d):
    """P9, P10, J8."""
    rows = hourly_of(spark, d)
    return clean.explode_segments(rows, rows.where("obs_c > 150").select("time")).groupBy("segment").agg(F.count("*").alias("n"), F.avg("obs_c").alias("mean_c"))
