"""Normalisation, scaling, correlation, bootstrap intervals and feature selection."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.functions import columns as C
from heatloom.operators import selection
from heatloom.operators.clean import filter_period

EPSILON = 1e-6
#: Draws that a task holds at a time.
AT_ONCE = 1 << 20


def long_form(df: DataFrame, cols: list[str], ids: list[str] = ()) -> DataFrame:
    """ids, variable, value: a row for each of the columns, NaN and infinities as null."""
    return df.select(*ids, *[C.finite(F.col(c)).alias(c) for c in cols]).unpivot(list(ids), cols, "variable", "value")


def norm_stats(df: DataFrame, cols: list[str], floor: float = 0.01, period: tuple[str, str] | None = None, inclusive_end: bool = True) -> DataFrame:
    """variable, mean, std_raw (population), near_zero, std (at least floor) in one pass over the rows; with a period those of its times alone, its end as well unless told otherwise."""
    df = filter_period(df, *period, inclusive_end=inclusive_end) if period else df
    stats = long_form(df, cols).groupBy("variable").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std_raw"))
    return stats.select("variable", "mean", "std_raw", (F.col("std_raw") < floor).alias("near_zero"), F.greatest("std_raw", F.lit(floor)).alias("std"))


def zscore(df: DataFrame, stats: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Long rows (variable, value) with value normalised by stats; without epsilon a std of 0 counts as 1."""
    s = stats.select("variable", F.col("mean").alias("__m"), F.col("std").alias("__s"))
    scale = F.col("__s") + epsilon if epsilon else F.when(F.col("__s") == 0, 1.0).otherwise(F.col("__s"))
    return df.join(F.broadcast(s), "variable").withColumn("value", (F.col("value") - F.col("__m")) / scale).drop("__m", "__s")  # a row a variable


def denorm(df: DataFrame, stats: DataFrame) -> DataFrame:
    s = stats.select("variable", F.col("mean").alias("__m"), F.col("std").alias("__s"))
    return df.join(F.broadcast(s), "variable").withColumn("value", F.col("value") * F.col("__s") + F.col("__m")).drop("__m", "__s")


def summarise_vars(df: DataFrame, cols: list[str]) -> DataFrame:
    v = F.col("value")
    return long_form(df, cols).groupBy("variable").agg(
        F.avg(v.isNull().cast("double")).alias("nan_fraction"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        (100 * F.avg((v == 0).cast("double"))).alias("zero_pct"),
    )


def complete(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[C.finite(F.col(c)).alias(c) for c in cols]).na.drop()


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """a, b, r: Pearson correlation of each pair (a before b in cols) on rows where all columns are finite, in one aggregation."""
    pairs = list(combinations(cols, 2))
    one = complete(df, cols).agg(*[C.corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)]))
    return one.select(rows.alias("p")).select("p.*")


def corr_with_target(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    one = df.agg(*[C.corr(C.finite(F.col(c)), C.finite(F.col(target))).alias(c) for c in cols])
    return one.unpivot([], cols, "variable", "r")


def vif(df: DataFrame, cols: list[str]) -> DataFrame:
    """variable, vif: 1 / (1 - R²) of each column on the others, R² within [0, 0.999999]; null for under p + 5 rows.

    Spark makes the p x p correlations; their inverse's diagonal is numpy's.
    """
    n = complete(df, cols).count()
    r = np.eye(len(cols))
    for row in corr_matrix(df, cols).collect():  # p(p - 1) / 2 rows
        i, j = cols.index(row.a), cols.index(row.b)
        r[i, j] = r[j, i] = row.r or 0.0
    diagonal = np.diag(np.linalg.pinv(r))
    r2 = np.clip(1 - 1 / np.maximum(diagonal, 1e-12), 0, 0.999999)
    values = [None if n < len(cols) + 5 else float(1 / (1 - x)) for x in r2]
    return df.sparkSession.createDataFrame(list(zip(cols, values, strict=True)), "variable string, vif double")


def robust_scale(df: DataFrame, cols: list[str], low: float = 0.02, high: float = 0.98, fall_back: bool = True) -> DataFrame:
    """Columns between their percentiles, clipped to [0, 1]; equal percentiles fall back to the extremes, a flat column is 0. Percentiles are exact (see selection)."""
    stats = selection.percentiles(df, {c: F.col(c) for c in cols}, [low, high])
    out = {}
    for c in cols:
        a, b = stats[c]["at"]
        if fall_back and a is not None and not b > a:
            a, b = stats[c]["min"], stats[c]["max"]
        out[c] = C.clip((C.finite(F.col(c)) - a) / (b - a), 0, 1) if a is not None and b > a else F.lit(0.0)
    return df.withColumns(out)


def top_pairs(corr: DataFrame, threshold: float, k: int) -> DataFrame:
    return corr.where(F.abs("r") >= threshold).orderBy(F.desc(F.abs("r")), "a", "b").limit(k)


def feature_drop_candidates(
    vifs: DataFrame, residual: DataFrame, pairs: DataFrame, redundant: list[tuple[str, str]], max_vif: float = 8, least_r: float = 0.20, pair_r: float = 0.85
) -> DataFrame:
    """variable, reason: a high inflation, a weak correlation with the residual, or the second of a known pair that correlates."""
    known = F.broadcast(vifs.sparkSession.createDataFrame(redundant or [("", "")], "a string, b string"))
    a = vifs.where(F.col("vif") >= max_vif).select("variable", F.lit("vif").alias("reason"))
    b = residual.where(F.abs("r") < least_r).select("variable", F.lit("weak").alias("reason"))
    c = pairs.join(known, ["a", "b"]).where(F.abs("r") >= pair_r).select(F.col("b").alias("variable"), F.lit("redundant").alias("reason"))
    return a.union(b).union(c).distinct()


def weak_inputs(corr: DataFrame, least_r: float = 0.10) -> DataFrame:
    """variable, r of the coarse inputs that hardly correlate with the target; an unknown correlation is no candidate."""
    return corr.where(F.abs(C.finite(F.col("r"))) < least_r).select("variable", "r")


def uniforms(hashes: np.ndarray, n: int) -> np.ndarray:
    """n numbers in 0 to 1 for each hash: the mixed bits of the hash and a counter."""
    x = hashes.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, n + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53


def poisson_draws(means: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """n Poisson numbers of each mean (whole, 1 or more), by inversion of the sums of probabilities, which equal means share."""
    u, out = uniforms(hashes, n), np.empty((len(means), n))
    for m in np.unique(means):
        reach = 12 * math.sqrt(m) + 30  # beyond, nothing is left in double precision
        k = np.arange(max(0, math.floor(m - reach)), math.ceil(m + reach))
        log_p = k[0] * math.log(m) - m - math.lgamma(k[0] + 1) + np.concatenate([[0.0], np.cumsum(math.log(m) - np.log(k[1:]))])
        below = np.cumsum(np.exp(log_p))
        own = means == m
        out[own] = k[0] + np.minimum(np.searchsorted(below / below[-1], u[own], side="right"), len(k) - 1)
    return out


def replicate_means(rows: DataFrame, by: list[str], n_boot: int, seed: int) -> DataFrame:
    """by, replicate, mean of n_boot resamples of the column value in each group.

    A value that occurs m times gets a Poisson(m) weight in each replicate, from a hash of the value, its keys and the seed: numbers don't depend on partitions. Tasks draw for a
    batch at once and sum weights and weighted values, so no group meets in one task. A replicate in which no row has a weight is left out.
    """
    counts = rows.groupBy(*by, "value").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64(*by, "value", F.lit(seed)))
    step = max(1, AT_ONCE // n_boot)

    def draw(batches):
        sums: dict[tuple, np.ndarray] = {}

        def taken():
            for key, (w, v) in sums.items():
                yield pd.DataFrame({**{c: [k] * n_boot for c, k in zip(by, key, strict=True)}, "replicate": np.arange(n_boot), "w": w, "s": v})
            sums.clear()

        for pdf in batches:
            pdf = pdf.assign(__g=pdf.groupby(by, sort=False, dropna=False).ngroup() if by else 0).sort_values("__g", kind="stable")
            for a in range(0, len(pdf), step):
                part = pdf.iloc[a : a + step]
                weight = poisson_draws(part.n.to_numpy(), part.h.to_numpy(), n_boot)
                _, starts = np.unique(part["__g"].to_numpy(), return_index=True)
                w = np.add.reduceat(weight, starts, axis=0)
                v = np.add.reduceat(weight * part.value.to_numpy(float)[:, None], starts, axis=0)
                for k, key in enumerate(part[by].iloc[starts].itertuples(index=False, name=None)):
                    own = sums.setdefault(key, np.zeros((2, n_boot)))
                    own += (w[k], v[k])
                if len(sums) >= 500:
                    yield from taken()
        yield from taken()

    keys = "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in by)
    sums = counts.mapInPandas(draw, keys + "replicate int, w double, s double").groupBy(*by, "replicate").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))
    return sums.where("w > 0").select(*by, "replicate", (F.col("s") / F.col("w")).alias("mean"))


def bootstrap_mean_ci(raw: DataFrame, by: list[str], metrics: list[str] = ("mae", "rmse", "ssim"), n_boot: int = 2000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """by, variable, n, mean, low, high: percentile interval of the resampled mean (Poisson weights); one value is its own interval. Results repeat with the seed."""
    rows = long_form(raw, list(metrics), by).where("value is not null")
    keys = [*by, "variable"]
    own = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    ends = replicate_means(rows, keys, n_boot, seed).groupBy(*keys).agg(F.percentile("mean", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("ends"))
    end = lambda k: F.when(F.col("n") == 1, F.col("mean")).otherwise(F.get("ends", F.lit(k)))
    return own.join(ends, keys).select(*keys, "n", "mean", end(0).alias("low"), end(1).alias("high"))


def bootstrap_delta_ci(raw: DataFrame, baseline: str, metrics: list[str] = ("mae", "rmse", "ssim"), n_boot: int = 2000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """model, variable, delta, low, high of the gain over the baseline, both resampled; for ssim higher is better."""
    rows = long_form(raw, list(metrics), ["model"]).where("value is not null")
    sign = F.when(F.col("variable") == "ssim", -1.0).otherwise(1.0)

    def against(means: DataFrame, keys: list[str]) -> DataFrame:
        base = means.where(F.col("model") == baseline).select(*keys, F.col("mean").alias("base"))
        return means.where(F.col("model") != baseline).join(base, keys).withColumn("delta", sign * (F.col("base") - F.col("mean")))

    whole = against(rows.groupBy("model", "variable").agg(F.avg("value").alias("mean")), ["variable"])
    drawn = against(replicate_means(rows, ["model", "variable"], n_boot, seed), ["variable", "replicate"])
    ends = drawn.groupBy("model", "variable").agg(F.percentile("delta", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("ends"))
    return whole.join(ends, ["model", "variable"]).select("model", "variable", "delta", F.get("ends", F.lit(0)).alias("low"), F.get("ends", F.lit(1)).alias("high"))
