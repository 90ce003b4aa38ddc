"""Heat thresholds, exceedance, alerts and events."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatloom.functions import columns as C

# Base thresholds of the levels, and the percentile and margin that may raise each.
BASE = {"normal": 28.0, "watch": 30.0, "warning": 33.0, "severe": 36.0}
RAISED_BY = {"normal": (0.75, 2.0), "watch": (0.90, 1.0), "warning": (0.95, 0.0), "severe": (0.99, 0.0)}


def hourly_station_mean(obs: DataFrame, extra: list[str] = ()) -> DataFrame:
    """time (hour), station_id, obs_c (mean), n_obs_raw of readings with a value."""
    rows = obs.withColumns({"time": C.floor_hour(F.col("time")), "obs_c": C.finite(F.col("obs_c"))})
    return rows.groupBy("time", "station_id", *extra).agg(F.avg("obs_c").alias("obs_c"), F.count("obs_c").alias("n_obs_raw")).where("n_obs_raw > 0")


def station_coverage(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("station_id").agg(F.count("obs_c").alias("hours_with_data"), F.avg("obs_c").alias("mean_c"))


def daily_tmax(df: DataFrame, keys: list[str], value: str, offset_h: int = 0, full_days: bool = False) -> DataFrame:
    """keys, day, tmax; with full_days a row with a null tmax for each day without values between the table's first and last day."""
    day = F.to_date(F.col("time") + F.make_interval(hours=F.lit(offset_h)))
    out = df.groupBy(*keys, day.alias("day")).agg(F.max(C.finite(F.col(value))).alias("tmax"))
    if not full_days:
        return out
    span = out.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return out.select(*keys).distinct().crossJoin(F.broadcast(span)).join(out, [*keys, "day"], "left")  # keys x days: the table of a full series


def percentile_threshold(tmax: DataFrame, keys: list[str], p: float = 0.95, months: list[int] | None = None, before: str | None = None) -> DataFrame:
    """keys, thr: exact linear percentile of the daily maxima of the given months before a date."""
    rows = tmax.where("tmax is not null")
    if months:
        rows = rows.where(F.month("day").isin(months))
    if before:
        rows = rows.where(F.col("day") < F.lit(before).cast("date"))
    return rows.groupBy(*keys).agg(F.percentile("tmax", p).alias("thr"))


def exceed_fraction(tmax: DataFrame, thr: DataFrame, keys: list[str], least: float = 0.10) -> DataFrame:
    """day, exceed_fraction of valid keys over their threshold, is_heatwave_day. A day without valid keys has a null fraction and no flag."""
    over = F.when(F.col("tmax").isNotNull() & F.col("thr").isNotNull(), (F.col("tmax") > F.col("thr")).cast("double"))
    days = tmax.join(thr, keys, "left").groupBy("day").agg(F.avg(over).alias("exceed_fraction"))
    return days.withColumn("is_heatwave_day", F.coalesce((F.col("exceed_fraction") >= least).cast("int"), F.lit(0)))


def events_from_flags(daily: DataFrame, flag: str, day: str = "day", min_days: int = 3, adjacency: str = "row", by: list[str] = (), extra: dict[str, Column] | None = None) -> DataFrame:
    """by, event_id, start_date, end_date, duration_days and extra aggregates of runs of at least min_days flagged days.

    Runs follow rows (a missing date doesn't break them) or, with adjacency "date", dates. Ids count from 1 in order of time. The windows run over
    one row a day for each `by`, so they stay small.
    """
    order = Window.partitionBy(*by).orderBy(day)
    rows = daily.withColumn("__n", F.row_number().over(order) if adjacency == "row" else F.datediff(day, F.lit("1970-01-01").cast("date")))
    hot = rows.where(F.col(flag) == 1).withColumn("__run", F.col("__n") - F.row_number().over(order))
    runs = hot.groupBy(*by, "__run").agg(F.min(day).alias("start_date"), F.max(day).alias("end_date"), F.count("*").alias("duration_days"), *[c.alias(k) for k, c in (extra or {}).items()])
    out = runs.where(F.col("duration_days") >= min_days).drop("__run")
    return out.withColumn("event_id", F.row_number().over(Window.partitionBy(*by).orderBy("start_date")).cast("bigint"))


def heat_peaks(level: str = "alert_level", max_c: str = "max_pred_c") -> dict[str, Column]:
    """Peak aggregates of alert days for events_from_flags: the peak day is the first of the largest exceedance; days without one come last."""
    rank = C.level_rank(F.col(level))
    least = F.coalesce(-C.finite(F.col("max_exceedance_c")), F.lit(math.inf))
    return {
        "peak_date": F.min_by("day", F.struct(least, F.col("day"))), "peak_max_exceedance_c": F.max("max_exceedance_c"), "peak_alert_level": F.max_by(level, rank),
        "peak_exceed_fraction": F.max("exceed_fraction"), "mean_exceed_fraction": F.avg("exceed_fraction"), "peak_max_pred_c": F.max(max_c),
    }


def _alerts(joined: DataFrame, by: str, value: str) -> DataFrame:
    v, thr = C.finite(F.col(value)), F.col("thr")
    over = F.coalesce((v > thr).cast("int"), F.lit(0))  # a cell without a value doesn't exceed, and counts as a cell
    above = F.when(v.isNotNull(), F.greatest(v - thr, F.lit(0.0)))
    out = joined.groupBy(by).agg(
        F.avg(over.cast("double")).alias("exceed_fraction"), F.sum(over).cast("bigint").alias("affected_cells"), F.count("*").alias("total_cells"),
        F.avg(v).alias("mean_pred_c"), F.max(v).alias("max_pred_c"), F.avg(above).alias("mean_exceedance_c"), F.max(v - thr).alias("max_exceedance_c"),
    )
    return out.withColumn("alert_level", C.alert_level(F.col("exceed_fraction")))


def hourly_alerts(pred: DataFrame, thr: DataFrame, cell: list[str] = ("y", "x"), value: str = "pred_c") -> DataFrame:
    """time and the alert figures of each hour; pred (time, cell, value), thr (cell, thr)."""
    return _alerts(pred.join(thr, list(cell)), "time", value)


def daily_alerts(pred: DataFrame, thr: DataFrame, cell: list[str] = ("y", "x"), value: str = "pred_c") -> DataFrame:
    """day and the alert figures of each day, on each cell's daily maximum."""
    most = pred.groupBy(*cell, F.to_date("time").alias("day")).agg(F.max(C.finite(F.col(value))).alias(value))
    return _alerts(most.join(thr, list(cell)), "day", value)


def in_event(df: DataFrame, events: DataFrame, day: str = "day") -> DataFrame:
    """df with the event_id whose dates hold the day; null outside. Events of one series don't overlap and are few; Spark decides on the broadcast."""
    e = events.select(F.col("event_id"), F.col("start_date").alias("__a"), F.col("end_date").alias("__b"))
    return df.join(e, F.col(day).between(F.col("__a"), F.col("__b")), "left").drop("__a", "__b")


def event_hours(events: DataFrame) -> DataFrame:
    """event_id, time: all hours of the events' days."""
    first, last = F.col("start_date").cast("timestamp"), F.col("end_date").cast("timestamp") + F.expr("interval 23 hours")
    return events.select("event_id", F.explode(F.sequence(first, last, F.expr("interval 1 hour"))).alias("time"))


def latest(df: DataFrame, by: list[str], time: str = "time") -> DataFrame:
    """The newest row for each of `by` (of all rows without)."""
    rest = [c for c in df.columns if c not in by]
    row = F.max_by(F.struct(*rest), F.struct(time, *[c for c in rest if c != time])).alias("__r")
    return df.groupBy(*by).agg(row).select(*by, "__r.*")


def alert_summary(hourly: DataFrame, daily: DataFrame, events: DataFrame) -> DataFrame:
    """One row: counts, time span, highest level, the latest hour's level and whether an event is active on its day."""
    h = hourly.agg(
        F.count("*").alias("n_hours"), F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.max_by("alert_level", C.level_rank(F.col("alert_level"))).alias("highest_level"),
        F.max_by("alert_level", "time").alias("latest_level"), F.max_by("exceed_fraction", "time").alias("latest_fraction"),
    )
    d, e = daily.agg(F.count("*").alias("n_days")), events.agg(F.count("*").alias("n_events"))
    last = hourly.agg(F.to_date(F.max("time")).alias("day"))
    active = in_event(last, events).agg(F.bool_or(F.col("event_id").isNotNull()).alias("is_active_heatwave_event"))
    return h.crossJoin(d).crossJoin(e).crossJoin(active)  # one row each


def heat_events_cooldown(alerts: DataFrame, by: list[str], min_h: float = 6, cooldown_h: float = 12, silence_h: float | None = None) -> DataFrame:
    """by, start, end, duration_hours, peak_level, peak_temp, peak_area of events with a cooldown.

    An event opens at a warning or severe row and closes at the first other row at least cooldown_h after the last such row; the time until then belongs to it. Shorter
    ones than min_h and the open one are left out. With silence_h, more hours than that without a row end what is open, silence_h after the last row, and so does the end of the rows. alerts: by, time, alert_level, max_pred_c, exceed_fraction. The limited history of a live detector isn't kept.
    """
    order, session = Window.partitionBy(*by).orderBy("time"), F.lit(0)
    if silence_h is not None:
        silent = F.unix_micros("time") - F.unix_micros(F.lag("time").over(order)) > silence_h * 3_600_000_000
        session = F.coalesce(F.sum("__silent").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
        alerts = alerts.withColumn("__silent", silent.cast("int"))
    alerts = alerts.withColumn("__s", session)
    order = Window.partitionBy(*by, "__s").orderBy("time")
    hot = F.col("alert_level").isin("warning", "severe")
    rows = alerts.withColumn("__hot", hot).withColumn("__last", F.last(F.when(hot, F.col("time")), True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    quiet = (F.unix_timestamp("time") - F.unix_timestamp("__last")) / 3600.0
    rows = rows.withColumn("__close", ~F.col("__hot") & (quiet >= cooldown_h))
    # a closing row ends what came before; the next event begins with the first hot row after it
    rows = rows.withColumn("__k", F.coalesce(F.sum(F.col("__close").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    is_hot = lambda c: F.when(F.col("__hot"), F.col(c))
    rank = F.when(F.col("__hot"), C.level_rank(F.col("alert_level")))
    closed = F.max(F.when(F.col("__close"), F.col("time")))
    if silence_h is not None:
        closed = F.coalesce(closed, F.max("time") + F.make_dt_interval(secs=F.lit(silence_h * 3600)))
    runs = rows.groupBy(*by, "__s", "__k").agg(
        F.min(is_hot("time")).alias("start"), closed.alias("end"),
        F.max_by("alert_level", rank).alias("peak_level"), F.max(is_hot("max_pred_c")).alias("peak_temp"), F.max(is_hot("exceed_fraction")).alias("peak_area"),
    ).where("start is not null and end is not null")
    runs = runs.withColumn("duration_hours", (F.unix_timestamp("end") - F.unix_timestamp("start")) / 3600.0)
    return runs.where(F.col("duration_hours") >= min_h).drop("__s", "__k")


def dynamic_thresholds(history: DataFrame, least_rows: int = 24) -> DataFrame:
    """month, hour and a threshold for each level: the base one, raised by percentiles of the maxima where there are enough rows. history: time, max."""
    groups = history.groupBy(F.month("time").alias("month"), F.hour("time").alias("hour"))
    stats = groups.agg(F.count("*").alias("n"), *[F.percentile("max", p).alias(f"__{k}") for k, (p, _) in RAISED_BY.items()])
    level = {k: F.when(F.col("n") < least_rows, BASE[k]).otherwise(F.greatest(F.lit(BASE[k]), F.col(f"__{k}") - margin)) for k, (_, margin) in RAISED_BY.items()}
    return stats.select("month", "hour", "n", *[c.alias(k) for k, c in level.items()])
