"""Tables of metric rows: means, ranks, deltas, stability, audits of artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatloom.functions import columns as C

#: Orders of the reports; the model's name comes last.
ORDERS = {
    "narrative": lambda: [F.asc_nulls_last("RMSE"), F.asc_nulls_last("MAE"), F.desc_nulls_last("Corr")],
    "ablation": lambda: [F.asc_nulls_last("MAE")],
    "consolidated": lambda: [F.desc_nulls_last("Corr"), F.asc_nulls_last("MAE")],
}


def rank_models(df: DataFrame, by: list[str], order: str | list[Column], model: str = "model") -> DataFrame:
    """df with rank 1, 2, ... in each group, without shared ranks."""
    columns = ORDERS[order]() if isinstance(order, str) else order
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*columns, model)).cast("bigint"))


def deviation(c: Column, kind: str) -> Column:
    """Population deviation, or the sample one with 0 for one value."""
    return F.stddev_pop(c) if kind == "pop" else F.when(F.count(c) == 1, 0.0).otherwise(F.try_divide(F.sqrt(F.var_pop(c) * F.count(c)), F.sqrt(F.count(c) - 1)))


def aggregate_models(raw: DataFrame, by: list[str], metrics: list[str] = ("mae", "rmse", "ssim"), std: str = "samp") -> DataFrame:
    """n, and mean and deviation of each metric's finite values."""
    return raw.groupBy(*by).agg(
        F.count("*").alias("n"), *[F.avg(C.finite(F.col(m))).alias(f"{m}_mean") for m in metrics], *[deviation(C.finite(F.col(m)), std).alias(f"{m}_std") for m in metrics]
    )


def by_model_seed(raw: DataFrame, metrics: list[str] = ("mae", "rmse", "ssim")) -> DataFrame:
    """n_events and mean metrics of each model and seed (from experiment); rows without a seed are left out."""
    rows = raw.withColumn("seed", C.extract_seed(F.col("experiment"))).where("seed is not null")
    return rows.groupBy("model", "seed").agg(F.count("*").alias("n_events"), *[F.avg(C.finite(F.col(m))).alias(f"{m}_mean") for m in metrics])


def day_night_pivot(raw: DataFrame, by: list[str], metrics: list[str], day: tuple[int, int] = (8, 19)) -> DataFrame:
    """Overall, day and night means of each metric side by side."""
    is_day = C.hour_in_window(F.col("time"), *day)
    cols = []
    for m in metrics:
        v = C.finite(F.col(m))
        cols += [F.avg(v).alias(f"{m}_all"), F.avg(F.when(is_day, v)).alias(f"{m}_day"), F.avg(F.when(~is_day, v)).alias(f"{m}_night")]
    return raw.groupBy(*by).agg(F.count("*").alias("n"), *cols)


def training_summary(log: DataFrame) -> DataFrame:
    """model, seed, epochs, best val_loss and val_mae with their first epochs, and the last row's values."""
    first = lambda m: F.min_by("epoch", F.struct(m, "epoch"))
    return log.groupBy("model", "seed").agg(
        F.count("*").alias("epochs"), F.min("val_loss").alias("best_val_loss"), first("val_loss").alias("best_val_loss_epoch"), F.min("val_mae").alias("best_val_mae"),
        first("val_mae").alias("best_val_mae_epoch"), F.max_by("loss", "epoch").alias("last_loss"), F.max_by("val_loss", "epoch").alias("last_val_loss"), F.max_by("lr", "epoch").alias("last_lr"),
    )


def delta_vs_baseline(agg: DataFrame, baseline: str, lower: list[str] = ("mae", "rmse"), higher: list[str] = ("ssim",), model: str = "model") -> DataFrame:
    """Gain over the baseline row: baseline less model where lower is better, model less baseline elsewhere."""
    base = F.broadcast(agg.where(F.col(model) == baseline).limit(1).select(*[F.col(c).alias(f"__{c}") for c in [*lower, *higher]]))
    gains = {f"delta_{c}": F.col(f"__{c}") - F.col(c) for c in lower} | {f"delta_{c}": F.col(c) - F.col(f"__{c}") for c in higher}
    return agg.crossJoin(base).withColumns(gains).drop(*[f"__{c}" for c in [*lower, *higher]])


def rank_stability(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Ranks of two runs, and their difference where both have one."""
    x, y = a.select(*keys, F.col("rank").alias("rank_a")), b.select(*keys, F.col("rank").alias("rank_b"))
    return x.join(y, keys, "full_outer").withColumn("delta_rank", F.col("rank_b") - F.col("rank_a"))


def compare_protocols(reference: DataFrame, others: DataFrame, metrics: list[str] = ("RMSE", "MAE", "Corr")) -> DataFrame:
    """Compared less reference for equal segments and models; unmatched keys are left out."""
    r = reference.select("segment", "model", *[F.col(m).alias(f"{m}_reference") for m in metrics])
    return others.join(r, ["segment", "model"]).withColumns({f"delta_{m}": F.col(m) - F.col(f"{m}_reference") for m in metrics})


def pair_compare(raw: DataFrame, pairs: list[tuple[str, str]], metrics: list[str], key: str = "model") -> DataFrame:
    """run_a, run_b and b less a of each metric for the named pairs."""
    table = F.broadcast(raw.sparkSession.createDataFrame(pairs, "run_a string, run_b string"))
    side = lambda s: raw.select(F.col(key).alias(f"run_{s}"), *[F.col(m).alias(f"{m}_{s}") for m in metrics])
    joined = table.join(side("a"), "run_a").join(side("b"), "run_b")
    return joined.select("run_a", "run_b", *[(F.col(f"{m}_b") - F.col(f"{m}_a")).alias(f"delta_{m}") for m in metrics])


def consolidate_sections(sections: dict[str, DataFrame]) -> DataFrame:
    """Tables under one another, with their section's name; columns that one lacks are null."""
    out = None
    for name, df in sections.items():
        part = df.withColumn("section", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def check_artifact(df: DataFrame, required: list[str], numeric: list[str], least_rows: int = 1) -> DataFrame:
    """One row: missing columns, rows, non-finite values of the numeric columns that are there, and whether the artifact passes."""
    missing = [c for c in required if c not in df.columns]
    here = [c for c in numeric if c in df.columns]
    bad = sum((F.sum(C.finite(F.col(c)).isNull().cast("bigint")) for c in here), F.lit(0)).cast("bigint")
    stats = df.agg(F.count("*").alias("n_rows"), F.coalesce(bad, F.lit(0).cast("bigint")).alias("n_not_finite"))
    return stats.select(F.lit(",".join(missing)).alias("missing"), "n_rows", "n_not_finite", ((F.lit(len(missing)) == 0) & (F.col("n_rows") >= least_rows) & (F.col("n_not_finite") == 0)).alias("passed"))


def robustness_curve(rows: DataFrame) -> DataFrame:
    """Mean and population deviation of the mean absolute deviation for each model and noise, and the model's rank at that noise."""
    out = rows.groupBy("model", "epsilon_K").agg(F.avg("mean_abs_dev").alias("mean_dev"), F.stddev_pop("mean_abs_dev").alias("std_dev"))
    return rank_models(out, ["epsilon_K"], [F.asc_nulls_last("mean_dev")])


def station_model_matrix(per_station: DataFrame, models: list[str], sort_model: str, metric: str = "MAE") -> DataFrame:
    """A row a station with a column a model, by one model's value, nulls last; order is the row's place."""
    wide = per_station.groupBy("station_id").pivot("model", models).agg(F.first(metric))
    return wide.withColumn("order", F.row_number().over(Window.orderBy(F.asc_nulls_last(sort_model), "station_id")).cast("bigint"))  # a row a station


def metric_by_model_time(raw: DataFrame, metrics: list[str]) -> DataFrame:
    return raw.groupBy("model", "time").agg(*[F.avg(C.finite(F.col(m))).alias(m) for m in metrics])


def pivot_by_time(means: DataFrame, metric: str, models: list[str]) -> DataFrame:
    return means.groupBy("time").pivot("model", models).agg(F.first(metric))
