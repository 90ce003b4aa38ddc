"""Verification of predicted fields against stations and reference fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatloom.functions import columns as C
from heatloom.sources import io


def correlation(a: Column, b: Column, least: int = 2) -> Column:
    """Pearson correlation; null for fewer than `least` pairs or without variance."""
    n = F.count(F.when(a.isNotNull() & b.isNotNull(), 1))
    return F.when(n >= least, C.corr(a, b))


def metrics(pred: str, obs: str, suffix: str = "", mean: Callable[[Column], Column] = F.avg) -> list[Column]:
    """MAE, RMSE, Bias, Corr and N of pairs that are both finite; with C.exact_mean the first three don't depend on the rows' order."""
    p, o = C.finite(F.col(pred)), C.finite(F.col(obs))
    error = p - o
    return [
        mean(F.abs(error)).alias(f"MAE{suffix}"), F.sqrt(mean(error * error)).alias(f"RMSE{suffix}"), mean(error).alias(f"Bias{suffix}"),
        correlation(F.when(error.isNotNull(), p), F.when(error.isNotNull(), o)).alias(f"Corr{suffix}"), F.count(error).alias(f"N{suffix}"),
    ]


def verify(df: DataFrame, pred: str, obs: str, by: list[str] = (), mean: Callable[[Column], Column] = F.avg) -> DataFrame:
    return df.groupBy(*by).agg(*metrics(pred, obs, mean=mean))


def verify_grouping_sets(df: DataFrame, pred: str, obs: str, reference: str, sets: list[list[str]]) -> DataFrame:
    """Model against observations, reference against observations and model against reference, for several groupings in one pass.

    A column outside a row's grouping is null, and level is its grouping id.
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    groups = df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys])
    return groups.agg(F.grouping_id(*keys).cast("bigint").alias("level"), *metrics(pred, obs, "_model"), *metrics(reference, obs, "_reference"), *metrics(pred, reference, "_model_reference"))


def match_obs(pred: DataFrame, obs: DataFrame) -> DataFrame:
    """Predictions at stations with the finite observations of the same hour and station."""
    good = obs.select("time", "station_id", C.finite(F.col("obs_c")).alias("obs_c")).where("obs_c is not null")
    return pred.join(good, ["time", "station_id"])


def attach_station_meta(obs: DataFrame, meta: DataFrame) -> DataFrame:
    return obs.join(meta, "station_id", "left")


def flag_heatwave(df: DataFrame, hours: DataFrame) -> DataFrame:
    """is_heatwave: the row's time is in hours (time)."""
    known = hours.select("time").distinct().withColumn("is_heatwave", F.lit(True))
    return df.join(known, "time", "left").withColumn("is_heatwave", F.coalesce("is_heatwave", F.lit(False)))


def lag_table(pred: DataFrame, obs: DataFrame, lags: range = range(-3, 4)) -> DataFrame:
    """lag_h and the metrics of the stations' mean series, with predictions moved by that many hours."""
    p, o = pred.groupBy("time").agg(F.avg("pred_c").alias("pred_c")), obs.groupBy("time").agg(F.avg("obs_c").alias("obs_c"))
    moved = p.withColumn("lag_h", F.explode(F.array(*[F.lit(k) for k in lags]))).withColumn("time", F.col("time") + F.make_interval(hours=F.col("lag_h")))
    return moved.join(o, "time").groupBy("lag_h").agg(*metrics("pred_c", "obs_c"))


def bias_correct(df: DataFrame, calib: DataFrame, mode: str = "station") -> DataFrame:
    """df with pred_c less the mean error of calib (station_id, time, pred_c, obs_c) by station, or by station and hour; unknown keys lose nothing."""
    keys = ["station_id"] + (["__h"] if mode == "station_hour" else [])
    hours = lambda d: d.withColumn("__h", F.hour("time"))
    bias = hours(calib).groupBy(*keys).agg(F.avg(C.finite(F.col("pred_c") - F.col("obs_c"))).alias("__bias"))
    return hours(df).join(bias, keys, "left").withColumn("pred_c", F.col("pred_c") - F.coalesce("__bias", F.lit(0.0))).drop("__bias", "__h")


def frame_metrics(df: DataFrame, by: list[str] = ("model", "time"), pred: str = "pred_c", ref: str = "t_c") -> DataFrame:
    """MAE and RMSE, and mean and population deviation of both fields, of each frame."""
    e = F.col(pred) - F.col(ref)
    return df.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(pred).alias("pred_mean"), F.stddev_pop(pred).alias("pred_std"), F.avg(ref).alias("ref_mean"), F.stddev_pop(ref).alias("ref_std")
    )


def frame_metrics_pair(df: DataFrame, a: str = "pred_a", b: str = "pred_b", ref: str = "t_c", by: list[str] = ("time",)) -> DataFrame:
    """by, hour, and MAE, RMSE and means of two models' fields against the same reference in each frame: one pass, no join of two results. Means don't depend on the rows' order."""
    out = []
    for name, c in (("a", a), ("b", b)):
        e = C.finite(F.col(c) - F.col(ref))
        out += [C.exact_mean(F.abs(e)).alias(f"mae_model_{name}"), F.sqrt(C.exact_mean(e * e)).alias(f"rmse_model_{name}"), C.exact_mean(C.finite(F.col(c))).alias(f"pred_{name}_mean")]
    return df.groupBy(*by).agg(*out, C.exact_mean(C.finite(F.col(ref))).alias("hr_mean")).withColumn("hour", F.hour("time"))


def split_metrics(df: DataFrame, pred: str = "pred_c", ref: str = "t_c") -> DataFrame:
    """One row: MAE, RMSE and MSE over all cells and times."""
    e = F.col(pred) - F.col(ref)
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e * e).alias("mse"))


def first_n_times(df: DataFrame, n: int, stride: int = 1) -> DataFrame:
    """Rows of the first n times, every stride-th."""
    times = df.select("time").distinct()
    numbered = times.withColumn("__n", F.row_number().over(Window.orderBy("time")) - 1)  # a row a time step
    return df.join(numbered.where((F.col("__n") < n) & (F.col("__n") % stride == 0)).drop("__n"), "time", "left_semi")


def align_times(hr: DataFrame, lr: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both tables at their common hours, and one row with the numbers of hours kept and dropped; an error where there are none."""
    a, b = hr.select("time", F.lit(1).alias("__a")).distinct(), lr.select("time", F.lit(1).alias("__b")).distinct()
    times = io.written(a.join(b, "time", "full"), "times")  # one join for the counts and both tables
    number = lambda of: F.count(F.when(of, 1))
    in_a, in_b = F.col("__a").isNotNull(), F.col("__b").isNotNull()
    counts = times.agg(number(in_a & in_b).alias("n_common"), number(~in_b).alias("hr_dropped"), number(~in_a).alias("lr_dropped"))
    both = times.where(in_a & in_b).select("time")
    if both.isEmpty():
        raise ValueError("no common hours")
    return hr.join(both, "time", "left_semi"), lr.join(both, "time", "left_semi"), counts
