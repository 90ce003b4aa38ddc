"""Queries of readers and writers: a table is written in the layout that a reader expects, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatloom.operators import clean, heat
from heatloom.plans.base import GRID, OBS, RUNS, grid, obs, query, runs, table
from heatloom.plans.heat import ALERT_HOURLY, FIGURE_NAMES, alert_events_of, alerts_of, days_of
from heatloom.sources import io

MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


@query(f"WITH {OBS} SELECT time, station_id, lat, lon, obs_c FROM obs WHERE obs_c >= 10", "lat lon obs_c")
def station_obs(spark, d):
    """Readings as CSV under another name of the value column; readings under 10 are written as text that is no number, and go."""
    path = io.scratch(spark, "obs")
    value = F.when(F.col("obs_c") < 10, "n/a").otherwise(F.col("obs_c").cast("string"))
    rows = obs(spark, d).select("time", "station_id", "lat", "lon", value.alias("temperature_c"))
    rows.write.option("header", True).option("timestampFormat", MICROS).csv(path)
    return io.read_station_obs(spark, path)


@query(f"WITH {GRID} SELECT 'grid' AS model, time, y, x, pred_c FROM grid", "pred_c")
def prediction_maps(spark, d):
    """S3: a frame a week as a file; cells without a value are NaN in it, null when read, and left out here."""
    path = io.scratch(spark, "maps")
    io.write_prediction_maps(grid(spark, d).select("time", "y", "x", "pred_c"), path)
    return io.read_prediction_maps(spark, path, model="grid").where("pred_c is not null")


@query(
    """SELECT CAST(o_orderdate AS TIMESTAMP) AS time, CASE WHEN o_orderkey % 3 = 0 THEN '/far/' WHEN o_orderkey % 3 = 1 THEN 's3a://far/' ELSE '/root/maps/' END || CAST(o_orderkey AS VARCHAR) || '.npy' AS path
FROM orders"""
)
def manifest(spark, d):
    """Absolute paths, addresses and relative paths."""
    path, k = io.scratch(spark, "manifest"), F.col("o_orderkey")
    folder = F.when(k % 3 == 0, "/far/").when(k % 3 == 1, "s3a://far/").otherwise("maps/")
    rows = table(spark, d, "orders").select(F.col("o_orderdate").cast("timestamp").alias("time"), F.concat(folder, k.cast("string"), F.lit(".npy")).alias("path"))
    rows.write.option("header", True).csv(path)
    return io.read_manifest(spark, path, "/root/")


@query(f"WITH {OBS} SELECT DISTINCT date_trunc('hour', time) AS time FROM obs WHERE CAST(station_id AS INT) % 5 <> 0")
def timestamps(spark, d):
    """A list with comments and blank lines."""
    path, k = io.scratch(spark, "times"), F.col("station_id").cast("int")
    at = F.date_format("time", MICROS)
    line = F.when(k % 10 == 0, F.concat(F.lit("# "), at)).when(k % 10 == 5, F.lit("  ")).otherwise(at)
    obs(spark, d).select(line.alias("value")).write.text(path)
    return io.read_timestamps(spark, path)


@query(f"WITH {RUNS} SELECT experiment, CASE WHEN experiment = 'run' THEN 'lstm' ELSE lower(model) END AS model, mae, rmse, ssim, time FROM raw")
def metric_files(spark, d):
    """Metric rows in one file for each task; one alias."""
    path = io.scratch(spark, "metrics")
    model = F.when(F.col("experiment") == "run", " ConvLSTM").otherwise(F.col("model"))
    rows = runs(spark, d).withColumn("model", model)
    layout = spark.createDataFrame([], io.METRICS)
    rows = layout.unionByName(rows.select("experiment", "model", "mae", "rmse", "ssim", "time"), allowMissingColumns=True)
    rows.write.option("header", True).csv(path)
    return io.read_metrics(spark, path).select("experiment", "model", "mae", "rmse", "ssim", "time")


@query(f"WITH {ALERT_HOURLY} SELECT * FROM alerts", FIGURE_NAMES)
def alert_files(spark, d):
    """The hours' table of the written alerts, read back."""
    path, hourly, daily, events = io.scratch(spark, "alerts"), alerts_of(spark, d), days_of(spark, d), alert_events_of(spark, d)
    io.write_alerts(hourly, daily, events, heat.alert_summary(hourly, daily, events), path)
    return spark.read.schema(hourly.schema).option("header", True).csv(f"{path}/hourly")


@query(
    f"""WITH {RUNS} SELECT variant AS run, time, CASE WHEN variant <> 'O' THEN mae END AS mae, CASE WHEN variant <> 'F' THEN rmse END AS rmse FROM raw"""
)
def union_runs(spark, d):
    """Three runs, two of which lack a column."""
    rows, columns = runs(spark, d), {"F": ["mae"], "O": ["rmse"], "P": ["mae", "rmse"]}
    parts = {name: rows.where(F.col("variant") == name).select("time", *own) for name, own in columns.items()}
    return clean.union_runs(parts, "run").select("run", "time", "mae", "rmse")
