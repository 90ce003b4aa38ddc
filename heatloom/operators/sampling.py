"""Weighted sampling of times and tiles, sequences, perturbation and robustness."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatloom.operators import ranges, selection
from heatloom.operators.stats import robust_scale


def normalised(df: DataFrame, raw: Column, min_prob: float = 1e-6, gamma: float = 1.0) -> DataFrame:
    """df with weight: raw less its least value, to the power gamma, plus min_prob, summing to 1. Totals are one broadcast row."""
    rows = df.withColumn("__r", F.coalesce(raw, F.lit(0.0)))
    least = F.broadcast(rows.agg(F.min("__r").alias("__m")))
    rows = rows.crossJoin(least).withColumn("__w", F.pow(F.col("__r") - F.col("__m"), F.lit(gamma)) + min_prob).drop("__r", "__m")
    total = F.broadcast(rows.agg(F.sum("__w").alias("__t")))
    return rows.crossJoin(total).withColumn("weight", F.col("__w") / F.col("__t")).drop("__w", "__t")


def temporal_weights(series: DataFrame, gamma: float = 1.0, min_prob: float = 1e-6) -> DataFrame:
    """series (time, value: the domain's mean) with weight by the change since the step before; the first step has none."""
    rows = ranges.with_previous(series, "value", ["time"], "__v")
    change = F.coalesce(F.abs(F.col("value") - F.col("__v")), F.lit(0.0))
    return normalised(rows.withColumn("change", change).drop("__v"), F.col("change"), min_prob, gamma)


def p95_weights(series: DataFrame, min_prob: float = 1e-6) -> DataFrame:
    """series with weight by the excess over its 95th percentile. The reference's own switch never reaches this; its evident intent is built."""
    q = selection.percentiles(series, {"value": F.col("value")}, [0.95])["value"]["at"][0]
    rows = series.withColumn("__e", F.greatest(F.col("value") - F.lit(q), F.lit(0.0)) + min_prob)
    total = F.broadcast(rows.agg(F.sum("__e").alias("__t")))
    return rows.crossJoin(total).withColumn("weight", F.col("__e") / F.col("__t")).drop("__e", "__t")


def weights_cdf(df: DataFrame, order: list[str]) -> DataFrame:
    """df with low and high: the running sum of weights before and after each row; the last one ends at 1 or above. Sums run inside ranges of the order (see ranges)."""
    rows = ranges.running_sum(df, "weight", order)
    end = F.broadcast(rows.agg(F.max(F.struct(*order)).alias("__end")))
    is_last = F.struct(*order) == F.col("__end")
    high = F.when(is_last, F.greatest("__upto", F.lit(1.0))).otherwise(F.col("__upto"))
    return rows.crossJoin(end).withColumns({"high": high, "low": F.col("__before")}).drop("__before", "__upto", "__end")


def draws(spark, n: int, seed: int) -> DataFrame:
    """draw, u: n uniform numbers that repeat with the seed."""
    u = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2**53)).cast("double") / float(2**53)
    return spark.range(n).select(F.col("id").alias("draw"), u.alias("u"))


def sample_times(cdf: DataFrame, n: int, seed: int) -> DataFrame:
    """draw and the row of cdf that holds its number: n draws with replacement by weight.

    The numbers from 0 to 1 are cut into as many parts as there are draws (a million at most); draws and rows meet by part, a row in all parts that it reaches into.
    """
    parts = max(1, min(n, 1_000_000))
    part = lambda c: F.least(F.floor(F.col(c) * parts), F.lit(parts - 1)).cast("int")
    rows = cdf.withColumn("__part", F.explode(F.sequence(part("low"), F.greatest(part("low"), part("high")))))
    drawn = draws(cdf.sparkSession, n, seed).withColumn("__part", part("u"))
    return drawn.join(rows, "__part").where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))).drop("u", "low", "high", "__part")


def season_balanced(times: DataFrame, season: Column) -> DataFrame:
    """times with weight so that each season that is there is equally likely, and its rows alike (by a column `raw`, if there is one)."""
    raw = F.col("raw") if "raw" in times.columns else F.lit(1.0)
    rows = times.withColumn("season", season)
    w = raw / F.sum(raw).over(Window.partitionBy("season"))
    k = F.broadcast(rows.agg(F.count_distinct("season").alias("__k")))
    return rows.withColumn("weight", w).crossJoin(k).withColumn("weight", F.col("weight") / F.col("__k")).drop("__k")


def tile_weights(static: DataFrame, mode: str, features: list[str], gamma: float = 1.0, min_prob: float = 1e-6) -> DataFrame:
    """static (y, x, features) with weight: mean absolute z-score, a heat-island proxy, or the error in the column `error`."""
    if mode == "error_weighted":
        return normalised(static, F.col("error"), min_prob, gamma)
    if mode == "static_weighted":
        stats = F.broadcast(static.agg(*[f(c).alias(f"__{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))]))
        z = [F.abs((F.col(c) - F.col(f"__m_{c}")) / (F.col(f"__s_{c}") + 1e-6)) for c in features]
        drop = [f"__{n}_{c}" for c in features for n in "ms"]
        rows = static.crossJoin(stats).withColumn("__score", sum(z[1:], z[0]) / len(z)).drop(*drop)
        return normalised(rows, F.col("__score"), min_prob, gamma).drop("__score")
    if mode != "uhi_proxy":
        raise ValueError(f"unknown mode {mode}")
    pick = lambda *names: next((F.col(c) for c in names if c in static.columns), None)
    built = pick("impervious_fraction", "building_density")
    if built is None:
        return tile_weights(static, "static_weighted", features, gamma, min_prob)
    zero = F.lit(0.0)
    svf = pick("svf")
    canyon = (1 - F.least(F.greatest(svf, zero), F.lit(1.0)) if svf is not None else zero) + (pick("h_over_w") if pick("h_over_w") is not None else zero)
    parts = {"__built": built, "__canyon": canyon, "__height": pick("avg_height", "height_index"), "__rough": pick("roughness"), "__green": pick("ndvi_mean")}
    rows = robust_scale(static.withColumns({k: (c if c is not None else zero).cast("double") for k, c in parts.items()}), list(parts))
    score = 0.45 * F.col("__built") + 0.25 * F.col("__canyon") + 0.15 * F.col("__height") + 0.10 * F.col("__rough") + 0.05 * (1 - F.col("__green"))
    return normalised(rows, score, min_prob, gamma).drop(*parts)


def sample_tiles(cdf: DataFrame, n: int, shape: tuple[int, int], patch: int = 96, alpha: float = 0.85, seed: int = 0, lr_shape: tuple[int, int] | None = None) -> DataFrame:
    """draw, y0, x0 of n tiles: around a weighted centre with probability alpha, else anywhere; within the frame. With lr_shape also the coarse corner ly, lx."""
    h, w = shape
    uniform = lambda k: F.pmod(F.xxhash64("draw", F.lit(seed + k)), F.lit(2**53)).cast("double") / float(2**53)
    rows = sample_times(cdf, n, seed).withColumn("weighted", uniform(1) < alpha)
    corner = lambda c, size: F.greatest(F.lit(0), F.least(F.col(c) - patch // 2, F.lit(size - patch)))
    anywhere = lambda k, size: F.floor(uniform(k) * max(1, size - patch + 1)).cast("int")
    out = rows.select(
        "draw", F.when(F.col("weighted"), corner("y", h)).otherwise(anywhere(2, h)).cast("int").alias("y0"), F.when(F.col("weighted"), corner("x", w)).otherwise(anywhere(3, w)).cast("int").alias("x0")
    )
    if lr_shape:
        lh, lw = lr_shape
        size = lambda k, m: max(1, round(patch * m / k))
        low = lambda c, k, m: F.greatest(F.lit(0), F.least(F.bround(F.col(c) * (m / k)).cast("int"), F.lit(max(0, m - size(k, m)))))
        out = out.withColumns({"ly": low("y0", h, lh), "lx": low("x0", w, lw)})
    return out


def sequences(df: DataFrame, seq_len: int = 6, stride: int = 1, include_last: bool = False, value: str = "value") -> DataFrame:
    """start, label_time and the values of windows of seq_len steps; the label is the last step. The last possible window is left out, unless include_last.

    Steps are numbered, each is dealt to the windows that hold it, and a window's rows meet by key: no row carries an array before that.
    """
    steps = df.select("time", value).withColumn("n", F.row_number().over(Window.orderBy("time")) - 1)  # a row a time step
    total = F.broadcast(df.agg(F.count("*").alias("__t")))
    dealt = steps.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(seq_len - 1)))).withColumn("start", F.col("n") - F.col("k")).crossJoin(total)
    last = F.col("__t") - seq_len + (1 if include_last else 0)
    kept = dealt.where((F.col("start") >= 0) & (F.col("start") < last) & (F.col("start") % stride == 0))
    grouped = kept.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("k", "time", value))).alias("rows"))  # seq_len rows each
    return grouped.select(F.col("start").cast("bigint").alias("start"), F.element_at("rows", -1)["time"].alias("label_time"), F.transform("rows", lambda r: r[value]).alias("values"))


def perturb(lr: DataFrame, variable: str, eps: list[float], n_trials: int, seed: int = 0, clean: str | None = None) -> DataFrame:
    """A copy of lr for each noise and trial, with normal noise of that size on one variable (long rows: variable, value). `clean` names a further column for the value without noise."""
    copies = lr.withColumn("epsilon_K", F.explode(F.array(*[F.lit(float(e)) for e in eps]))).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(n_trials - 1))))
    # normal numbers from two uniform ones, which come from a hash of the whole row, so that they don't depend on partitions
    uniform = lambda k: (F.pmod(F.xxhash64(*[F.col(c) for c in copies.columns], F.lit(seed), F.lit(k)), F.lit(2**53)).cast("double") + 1) / float(2**53 + 1)
    normal = F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * math.pi * uniform(2))
    noisy = F.when(F.col("variable") == variable, F.col("value") + normal * F.col("epsilon_K")).otherwise(F.col("value"))
    return copies.withColumns({"value": noisy} | ({clean: F.col("value")} if clean else {}))


def subsample_stations(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Rows of n stations, chosen by a hash of id and seed."""
    chosen = df.select("station_id").distinct().orderBy(F.md5(F.concat(F.col("station_id"), F.lit(f":{seed}"))), "station_id").limit(n)
    return df.join(chosen, "station_id", "left_semi")


def robustness_summary(trials: DataFrame, clean: DataFrame, by: list[str]) -> DataFrame:
    """by and the spread over trials of each cell, in a frame: trials (by, trial, y, x, value), clean (model, time, y, x, clean, hr)."""
    cells = trials.groupBy(*by, "y", "x").agg((F.max("value") - F.min("value")).alias("range"), F.stddev_pop("value").alias("std"), F.avg("value").alias("mean"))
    keys = [k for k in by if k in clean.columns]
    joined = cells.join(clean, [*keys, "y", "x"])
    d, e = F.col("mean") - F.col("clean"), F.col("clean") - F.col("hr")
    return joined.groupBy(*by).agg(
        F.max("range").alias("max_range"), F.avg("std").alias("mean_std"), F.percentile("range", 0.95).alias("p95_range"), F.avg(F.abs(d)).alias("mean_abs_dev"), F.sqrt(F.avg(d * d)).alias("rmse_vs_clean"),
        F.avg(F.abs(e)).alias("mae_clean_vs_hr"), F.sqrt(F.avg(e * e)).alias("rmse_clean_vs_hr"),
    )


def cooling_by_pair(frames: DataFrame, pairs: DataFrame) -> DataFrame:
    """model, pair_id and mean, p10, p90, min, max of the change from t1 to t2 over cells (frames: model, time, y, x, value; pairs: pair_id, t1, t2, a short list)."""
    side = lambda k: frames.select("model", F.col("time").alias(f"t{k}"), "y", "x", F.col("value").alias(f"v{k}"))
    delta = F.col("v2") - F.col("v1")
    joined = side(1).join(pairs, "t1").join(side(2), ["model", "t2", "y", "x"]).withColumn("d", delta)
    return joined.groupBy("model", "pair_id").agg(F.avg("d").alias("mean"), F.percentile("d", 0.1).alias("p10"), F.percentile("d", 0.9).alias("p90"), F.min("d").alias("min"), F.max("d").alias("max"))


def cooling_summary(frames: DataFrame, pairs: DataFrame) -> DataFrame:
    """model, n_pairs and mean, p10, p90 over cells of each model's mean map of changes (as cooling_by_pair)."""
    side = lambda k: frames.select("model", F.col("time").alias(f"t{k}"), "y", "x", F.col("value").alias(f"v{k}"))
    changes = side(1).join(pairs, "t1").join(side(2), ["model", "t2", "y", "x"])
    cells = changes.groupBy("model", "y", "x").agg(F.avg(F.col("v2") - F.col("v1")).alias("d"))
    n = changes.groupBy("model").agg(F.count_distinct("pair_id").alias("n_pairs"))
    spread = cells.groupBy("model").agg(F.avg("d").alias("mean_delta_t"), F.percentile("d", 0.1).alias("p10_delta_t"), F.percentile("d", 0.9).alias("p90_delta_t"))
    return n.join(spread, "model")


def persistence(frames: DataFrame, threshold: float, nights: int = 3) -> DataFrame:
    """model, pct_persistent: the share of cells that are over the threshold in at least `nights` frames (one frame a night). The maker of the reference's maps isn't in its tree; this is our definition."""
    cells = frames.groupBy("model", "y", "x").agg(F.sum((F.col("value") > threshold).cast("int")).alias("n"))
    return cells.groupBy("model").agg((100 * F.avg((F.col("n") >= nights).cast("double"))).alias("pct_persistent"))


def anomalies(stats: DataFrame, by: list[str], window: int = 24) -> DataFrame:
    """by, time and the anomalies of rows (time, mean, max) with at least `window` rows so far: jumps, outliers and trends; null where there is none."""
    w = Window.partitionBy(*by).orderBy("time")
    n = F.row_number().over(w)
    before = w.rowsBetween(-(window - 1), -1)
    z = F.abs(F.col("mean") - F.avg("mean").over(before)) / (F.stddev_pop("mean").over(before) + 1e-6)
    rows = stats.withColumns({"__n": n, "__z": z, "__dm": F.abs(F.col("mean") - F.lag("mean").over(w)), "__dx": F.abs(F.col("max") - F.lag("max").over(w)), "__d": F.col("mean") - F.lag("mean").over(w)})
    five = w.rowsBetween(-4, 0)
    low, high, total = F.min("__d").over(five), F.max("__d").over(five), F.sum("__d").over(five)
    enough = F.col("__n") >= window
    return rows.select(
        *by, "time", F.when(enough & (F.col("__dm") > 5), F.col("__dm")).alias("mean_jump"), F.when(enough & (F.col("__dx") > 8), F.col("__dx")).alias("max_jump"),
        F.when(enough & (F.col("__z") > 3), F.col("__z")).alias("mean_outlier"), F.when(enough & (low > 0) & (total > 10), total).alias("rising_trend"),
        F.when(enough & (high < 0) & (total < -10), total).alias("falling_trend"),
    )
