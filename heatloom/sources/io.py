"""Readers and writers of the domain's files, all by Spark's own sources."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatloom.functions import columns as C
from heatloom.sources.frames import NpyFrames

# Names of the value column, first come first taken; file layouts.
OBS_NAMES = ("obs_c", "t2m_c", "air_temperature_c", "temperature_c", "value_c")
HOURLY = ("temperature_2m", "dew_point_2m", "wind_speed_10m", "wind_direction_10m", "precipitation", "shortwave_radiation")
METRICS = (
    "experiment string, model string, mae double, rmse double, ssim double, patch_size string, stride double, seq_len int, temporal_stride int, time_index int, "
    "time timestamp, scale_from string, pct_low double, pct_high double, vmin double, vmax double"
)


def read_station_obs(spark: SparkSession, path: str) -> DataFrame:
    """time, station_id, lat, lon, obs_c of CSV files; the first known value column that the header has; rows with a bad or missing value go."""
    raw = spark.read.option("header", True).csv(path)
    needed = ["time", "station_id", "lat", "lon"]
    value = next((c for c in OBS_NAMES if c in raw.columns), None)
    missing = [c for c in needed if c not in raw.columns] + ([] if value else ["a value column"])
    if missing:
        raise ValueError(f"columns missing: {missing}")
    number = lambda c: C.finite(F.col(c).try_cast("double"))
    return raw.select(F.col("time").try_cast("timestamp").alias("time"), F.col("station_id").cast("string"), number("lat").alias("lat"), number("lon").alias("lon"), number(value).alias("obs_c")).na.drop()


def forecast_rows(payload: DataFrame) -> DataFrame:
    """lat, lon, time and the variables: one row for each place and hour of rows (latitude, longitude, hourly: a struct of arrays)."""
    have = payload.schema["hourly"].dataType.names
    arrays = F.arrays_zip(*[F.col(f"hourly.{c}") for c in ("time", *HOURLY) if c in have])
    rows = payload.select(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.posexplode(arrays).alias("step", "h"))
    value = lambda c: F.col(f"h.{c}").cast("double") if c in have else F.lit(None).cast("double")
    return rows.select("lat", "lon", F.to_timestamp("h.time").alias("time"), *[value(c).alias(c) for c in HOURLY])


def read_forecast_json(spark: SparkSession, path: str) -> DataFrame:
    """Forecast payloads, a list of places or one, as hourly rows."""
    return forecast_rows(spark.read.option("multiLine", True).json(path))


def read_prediction_maps(spark: SparkSession, path: str, pattern: str = "*.npy", model: str = "model", start: str | None = None, end: str | None = None) -> DataFrame:
    """model, time (from the file's name, from start to before end, in UTC), y, x, pred_c of .npy frames (H x W, or H x W x 1). Frames of several shapes are an error; a name without a time is skipped.

    Filters on time drop whole files at planning; the session's setting for that is switched on.
    """
    spark.dataSource.register(NpyFrames)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"path": path, "pattern": pattern, "push": "true"} | {k: v for k, v in (("start", start), ("end", end)) if v}
    return spark.read.format("npy_frames").options(**options).load().select(F.lit(model).alias("model"), "time", "y", "x", "pred_c")


def write_prediction_maps(df: DataFrame, path: str) -> None:
    """A .npy frame for each time of df (time, y, x, pred_c), named by its time; cells without a row are NaN. A task holds one frame."""
    height, width = df.agg(F.max("y") + 1, F.max("x") + 1).first()

    def write(group: pd.DataFrame) -> pd.DataFrame:
        frame = np.full((height, width), np.nan)
        frame[group.y, group.x] = group.pred_c
        system, root = fs.FileSystem.from_uri(path)
        system.create_dir(root)
        with system.open_output_stream(f"{root}/{group['name'].iloc[0]}.npy") as f:
            np.save(out := io.BytesIO(), frame)
            f.write(out.getvalue())
        return group.iloc[:1][["name"]]

    frames = df.withColumn("name", F.date_format("time", "yyyy-MM-dd_HH-mm-ss")).groupBy("name")
    frames.applyInPandas(write, "name string").write.format("noop").mode("overwrite").save()


def read_manifest(spark: SparkSession, path: str, root: str) -> DataFrame:
    """time, path of a manifest CSV in order of time; relative paths are put under root."""
    raw = spark.read.option("header", True).csv(path)
    if not {"time", "path"} <= set(raw.columns):
        raise ValueError("a manifest needs time and path")
    absolute = F.col("path").rlike(r"^(/|[A-Za-z][A-Za-z0-9+.-]*:)")
    full = F.when(absolute, F.col("path")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.col("path")))
    return raw.select(F.col("time").cast("timestamp").alias("time"), full.alias("path")).orderBy("time", "path")


def read_timestamps(spark: SparkSession, path: str) -> DataFrame:
    """time: the distinct hours of a list, one a line; blank lines and those that begin with # are left out."""
    rows = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' and v not like '#%'")
    return rows.select(F.date_trunc("hour", F.col("v").cast("timestamp")).alias("time")).distinct()


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Rows of many metric files with a known header; model names without aliases."""
    return spark.read.schema(METRICS).option("header", True).csv(path).withColumn("model", C.label_model(F.col("model")))


def write_grid(df: DataFrame, path: str, time: str = "time") -> None:
    """Parquet by date, so that readers of a period touch only its folders; a date's rows go to one task's file."""
    df.withColumn("date", F.to_date(time)).repartition("date").write.mode("overwrite").partitionBy("date").parquet(path)


def read_grid(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """A grid of write_grid, from start (a date) to before end."""
    df = spark.read.parquet(path)
    if start:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    return df.where(F.col("date") < F.lit(end).cast("date")) if end else df


def write_alerts(hourly: DataFrame, daily: DataFrame, events: DataFrame, summary: DataFrame, path: str) -> None:
    """CSV tables of the alerts, and their summary as JSON with sorted keys."""
    for name, df in (("hourly", hourly), ("daily", daily), ("events", events)):
        (df if name == "hourly" else df.coalesce(1)).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")  # a row a day or an event
    summary.select(C.to_sorted_json(summary.columns).alias("value")).write.mode("overwrite").text(f"{path}/summary")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared one that spark.checkpoint.dir names; the folder goes when the program ends. A cluster must name one; where it is unset, a local master gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = os.path.join(tempfile.gettempdir(), "heatloom-scratch")
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _FOLDERS.append((spark, path))
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, for what is read several times."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Scratch folders of this program.
_FOLDERS: list[tuple[SparkSession, str]] = []


@atexit.register
def delete_scratch() -> None:
    while _FOLDERS:
        spark, path = _FOLDERS.pop()
        if spark.sparkContext._jsc is not None:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def files_in_order(spark: SparkSession, paths: list[str], into: str) -> None:
    """Moves the part files of tables into one folder and dates them one second apart, table by table and by name, so that a stream reads them in this order."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    system = hadoop.Path(into).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(hadoop.Path(into))
    n = 0
    for table in paths:
        for name in sorted(f.getPath().getName() for f in system.listStatus(hadoop.Path(table)) if f.getPath().getName().startswith("part-")):
            to = hadoop.Path(f"{into}/{n:05d}-{name}")
            system.rename(hadoop.Path(f"{table}/{name}"), to)
            system.setTimes(to, 1_700_000_000_000 + 1000 * n, -1)
            n += 1
