"""Variograms, spherical models, local kriging and its spatial cross-validation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatloom.functions import columns as C
from heatloom.operators import ranges, regions, selection
from heatloom.sources import io

MODEL = "struct<nugget: double, sill: double, range: double>"


def pool_rare_classes(df: DataFrame, cls: str, min_count: int = 400, groups: dict[int, int] | None = None) -> DataFrame:
    """Classes with few rows become -1; groups maps codes to a coarser class first."""
    if groups:
        table = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
        df = df.withColumn(cls, F.coalesce(F.try_element_at(table, F.col(cls)), F.col(cls)))
    counts = df.groupBy(cls).agg(F.count("*").alias("__n"))
    return df.join(counts, cls, "left").withColumn(cls, F.when(F.col("__n") < min_count, -1).otherwise(F.col(cls))).drop("__n")


def hashed_sample(points: DataFrame, n: int, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """The first n points by hash, of each `by` if given (rows without one take no part)."""
    rows = points.withColumn("__h", F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}"))))
    if not by:
        return rows.orderBy("__h", "id").limit(n).drop("__h")
    # by its first digits, a few times n of each group pass, so that no window holds a whole group
    share = F.conv(F.substring("__h", 1, 8), 16, 10).cast("double") / 2**32
    few = rows.join(points.groupBy(*by).agg(F.count("*").alias("__n")), by).where(share * F.col("__n") <= 4 * n + 64)
    return few.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy("__h", "id"))).where(F.col("__k") <= n).drop("__h", "__n", "__k")


def variogram(points: DataFrame, n_bins: int = 15, max_frac: float = 0.5, sample: int = 1_500, by: list[str] | None = None) -> DataFrame:
    """by, bin, lag, semivariance, n of pairs of at most `sample` points (id, x, y, value) of each `by`, up to a part of the largest distance; bins with 10 pairs."""
    by = by or []
    some = hashed_sample(points, sample, by=by).select(*by, "id", "x", "y", "value")
    other = some.select(*by, *[F.col(c).alias(f"__{c}") for c in ("id", "x", "y", "value")])
    d = F.sqrt((F.col("x") - F.col("__x")) ** 2 + (F.col("y") - F.col("__y")) ** 2)
    met = some.join(other, by) if by else some.crossJoin(other)  # pairs of the sample: the method's own bound
    pairs = met.where(F.col("id") < F.col("__id")).select(*by, d.alias("d"), (0.5 * (F.col("value") - F.col("__value")) ** 2).alias("g"))
    cut = F.broadcast(pairs.groupBy(*by).agg((F.max("d") * max_frac).alias("cut")))
    at = F.floor(F.try_divide(F.col("d"), F.col("cut")) * n_bins).cast("int")
    near = (pairs.join(cut, by) if by else pairs.crossJoin(cut)).where(F.col("d") <= F.col("cut"))
    binned = near.withColumn("bin", at).where(F.col("bin") < n_bins)
    return binned.groupBy(*by, "bin").agg(F.avg("d").alias("lag"), F.avg("g").alias("semivariance"), F.count("*").alias("n")).where("n >= 10")


def spherical(h: np.ndarray, nugget: float, sill: float, reach: float) -> np.ndarray:
    """Semivariance: nugget and a partial sill that is reached at `reach`; 0 at no distance."""
    part = np.minimum(np.asarray(h, float) / reach, 1.0)
    return np.where(np.asarray(h) == 0, 0.0, nugget + sill * (1.5 * part - 0.5 * part**3))


def fit_spherical(lag: np.ndarray, semi: np.ndarray) -> tuple[float, float, float] | None:
    """Nugget, partial sill and range by least squares over 24 ranges and 8 nuggets, the sill in closed form; none for under 4 bins."""
    if len(lag) < 4:
        return None
    reach, nugget = (g.ravel() for g in np.meshgrid(np.linspace(lag[1], lag[-1], 24), np.linspace(0, semi.max() / 2, 8), indexing="ij"))
    shape = spherical(np.broadcast_to(lag, (len(reach), len(lag))), 0.0, 1.0, reach[:, None])
    sill = np.maximum(((semi - nugget[:, None]) * shape).sum(1) / np.maximum((shape**2).sum(1), 1e-300), 1e-12)
    error = ((nugget[:, None] + sill[:, None] * shape - semi) ** 2).sum(1)
    k = int(error.argmin())
    return float(nugget[k]), float(sill[k]), float(reach[k])


def fit_models(variograms: DataFrame, by: list[str]) -> DataFrame:
    """by, nugget, sill, range of each group's variogram (bin, lag, semivariance): a few bins each. Groups that can't be fitted are left out."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        model = fit_spherical(pdf.lag.to_numpy(), pdf.semivariance.to_numpy())
        return pd.DataFrame([[*key, *model]] if model else [], columns=[*by, "nugget", "sill", "range"])

    schema = ", ".join(f"{k} {variograms.schema[k].dataType.simpleString()}" for k in by) + (", " if by else "") + "nugget double, sill double, range double"
    return variograms.groupBy(*by).applyInPandas(one, schema)


def solve_each(system: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solutions of a batch of systems; NaN where one is singular."""
    try:
        return np.linalg.solve(system, right)
    except np.linalg.LinAlgError:
        if len(system) == 1:
            return np.full_like(right, np.nan)
        half = len(system) // 2
        return np.concatenate([solve_each(system[:half], right[:half]), solve_each(system[half:], right[half:])])


def krige(target: np.ndarray, place: np.ndarray, value: np.ndarray, model: np.ndarray, batch: int = 256) -> np.ndarray:
    """Ordinary kriging of targets (n, 2) from k points of each (n, k, 2), their values (n, k) and a model of each (n, 3); the points' mean where a system is singular or a model is missing."""
    n, k = value.shape
    out = value.mean(1)
    for s in range(0, n, batch):
        at = s + np.nonzero(np.isfinite(model[s : s + batch]).all(1))[0]
        if not len(at):
            continue
        p, m = place[at], model[at].T
        system = np.ones((len(at), k + 1, k + 1))
        system[:, :k, :k] = spherical(np.sqrt(((p[:, :, None, :] - p[:, None, :, :]) ** 2).sum(-1)), *m[:, :, None, None])
        system[:, k, k] = 0
        system += np.eye(k + 1) * 1e-10
        right = np.ones((len(at), k + 1, 1))
        right[:, :k, 0] = spherical(np.sqrt(((target[at][:, None, :] - p) ** 2).sum(-1)), *m[:, :, None])
        got = (solve_each(system, right)[:, :k, 0] * value[at]).sum(1)
        out[at] = np.where(np.isfinite(got), got, out[at])
    return out


def local_kriging(targets: DataFrame, points: DataFrame, by: list[str], k: int = 48) -> DataFrame:
    """by, id, estimates: each value of points (by, id, x, y, values: array) at targets (by, id, x, y, models: an array of as many models, null ones for the neighbours' mean), from the k nearest points of the same by.

    All points take part and all targets are estimated; see `regions.with_neighbours` for ties, missing places and the size of groups. Values and models have the same length within a by.
    """

    def work(t: pd.DataFrame, p: pd.DataFrame, near: np.ndarray) -> pd.DataFrame:
        place, values = p[["x", "y"]].to_numpy()[near], np.stack(p["values"].to_list())
        models = np.array([[[np.nan] * 3 if m is None else [m["nugget"], m["sill"], m["range"]] for m in row] for row in t.models], float)
        target = t[["x", "y"]].to_numpy()
        out = np.stack([krige(target, place, values[:, f][near], models[:, f]) for f in range(models.shape[1])], axis=1)
        return pd.DataFrame({"id": t.id.to_numpy(), "estimates": list(out)})

    return regions.with_neighbours(targets.select(*by, "id", "x", "y", "models"), points.select(*by, "id", "x", "y", "values"), by, k, work, f"id {points.schema['id'].dataType.simpleString()}, estimates array<double>")


def fit_sampled(points: DataFrame, by: list[str], sample: int = 1_500) -> DataFrame:
    """by, model of at most `sample` points (id, x, y, value) of each by, by hash; groups that can't be fitted are left out."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        found = fit_spherical(*empirical(pdf[["x", "y"]].to_numpy(), pdf.value.to_numpy(), sample=sample))
        return pd.DataFrame([[*key, dict(zip(("nugget", "sill", "range"), found, strict=True))]] if found else [], columns=[*by, "model"])

    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # dear groups of few rows: not fewer tasks for their bytes
    some = hashed_sample(points, sample, by=by).repartition(tasks, *by)
    schema = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in by)
    return some.groupBy(*by).applyInPandas(one, f"{schema}, model {MODEL}")


def window_models(targets: DataFrame, points: DataFrame, by: str, k: int = 48, every: int = 200) -> DataFrame:
    """targets (by, id, x, y) with `moving`: the model of the k points (by, id, x, y, value) around the first of each `every` targets by id, or that of the window before where it can't be fitted.

    Windows of a by are one row each, in one order.
    """
    first = targets.groupBy(by).agg(F.count("*").alias("__c"))
    before = first.select(by, (F.sum("__c").over(Window.orderBy(by)) - F.col("__c")).alias("__base"))  # a row a fold
    numbered = ranges.row_numbers(targets, [by, "id"], "__n").join(F.broadcast(before), by)
    windows = numbered.withColumn("__w", F.floor((F.col("__n") - F.col("__base")) / every)).withColumn("__lead", (F.col("__n") - F.col("__base")) % every == 0).drop("__n", "__base")

    def work(t: pd.DataFrame, p: pd.DataFrame, near: np.ndarray) -> pd.DataFrame:
        xy, v = p[["x", "y"]].to_numpy(), p.value.to_numpy()
        found = [fit_spherical(*empirical(xy[n], v[n], n_bins=8)) for n in near]
        return pd.DataFrame({"__w": t["__w"].to_numpy(), "own": [None if m is None else dict(zip(("nugget", "sill", "range"), m, strict=True)) for m in found]})

    led = regions.with_neighbours(windows.where("__lead").select(by, "id", "x", "y", "__w"), points.select(by, "id", "x", "y", "value"), [by], k, work, f"__w bigint, own {MODEL}")
    carried = F.last("own", True).over(Window.partitionBy(by).orderBy("__w"))
    return windows.join(led.select(by, "__w", carried.alias("moving")), [by, "__w"], "left").drop("__w", "__lead")


def empirical(xy: np.ndarray, v: np.ndarray, n_bins: int = 15, max_frac: float = 0.5, sample: int = 1_500, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Lags and semivariances of an array of points, as `variogram`."""
    some = np.random.default_rng(seed).permutation(len(xy))[:sample]
    p, z = xy[some], v[some]
    i, j = np.triu_indices(len(p), 1)
    d, g = np.sqrt(((p[i] - p[j]) ** 2).sum(1)), 0.5 * (z[i] - z[j]) ** 2
    if not len(d):
        return np.zeros(0), np.zeros(0)
    cut = d.max() * max_frac
    near = d <= cut
    d, g = d[near], g[near]
    if len(d) < 30 or cut <= 0:
        return np.zeros(0), np.zeros(0)
    at = np.floor(d / cut * n_bins).astype(int)
    d, g, at = d[at < n_bins], g[at < n_bins], at[at < n_bins]
    n = np.bincount(at, minlength=n_bins)
    full = n >= 10
    return np.bincount(at, d, n_bins)[full] / n[full], np.bincount(at, g, n_bins)[full] / n[full]


def block_folds(points: DataFrame, n_blocks: int = 4) -> DataFrame:
    """points with fold: quantile blocks in x and in y."""
    half = n_blocks // 2
    cuts = [k / half for k in range(1, half)]
    edges = selection.percentiles(points, {c: F.col(c) for c in "xy"}, cuts)
    at = lambda c: sum((F.when(F.col(c) >= e, 1).otherwise(0) for e in edges[c]["at"]), F.lit(0))
    return points.withColumn("fold", at("x") * half + at("y"))


METHODS = ("global", "class_drift", "moving_window", "per_class")
#: Least points of a fold and outside it, and of a class outside it, for kriging (fixed values).
LEAST_HELD, LEAST_TRAIN, LEAST_CLASS = 20, 200, 60


def block_predictions(points: DataFrame, n_blocks: int = 4, sample: int = 0, seed: int = 0, k: int = 48) -> DataFrame:
    """fold, id, value and a column for each method: kriging of every point (id, x, y, value, cls) from the points outside its spatial block.

    global: one mean and one model; class_drift: the classes' means and one model of what is left; moving_window: models of windows of 200 points; per_class: each class for itself, or class_drift
    where it has few points or no model. All points are used unless `sample` says how many. Points without a finite place or value take no part, nor do folds with few points or without a model.
    """
    fine = points.select("id", "cls", *[C.finite(F.col(c).cast("double")).alias(c) for c in ("x", "y", "value")]).dropna(subset=["x", "y", "value"])
    folded = block_folds(hashed_sample(fine, sample, seed) if sample else fine, n_blocks)
    rows = io.written(folded.withColumn("cls", F.coalesce(F.col("cls").cast("string"), F.lit("none"))), "kriging")

    sums = rows.groupBy("fold", "cls").agg(F.count("*").alias("n"), F.sum("value").alias("s"))  # a row a fold and class
    folds = sums.groupBy("fold").agg(F.sum("n").alias("n_held")).where(F.col("n_held") >= LEAST_HELD).select(F.col("fold").alias("held"))
    outside = folds.crossJoin(F.broadcast(sums)).where("held <> fold")
    means = outside.groupBy("held").agg((F.sum("s") / F.sum("n")).alias("mean"), F.sum("n").alias("n_train")).where(F.col("n_train") >= LEAST_TRAIN)
    of_class = outside.groupBy("held", "cls").agg((F.sum("s") / F.sum("n")).alias("class_mean"), F.sum("n").alias("n_class"))
    known = F.broadcast(io.written(of_class.join(means.drop("n_train"), "held"), "kriging"))

    train = rows.join(known, "cls").where("held <> fold")
    residual = lambda pool, *of: train.select("held", pool.alias("pool"), "id", "x", "y", "n_class", F.array(*[F.col("value") - F.col(m) for m in of]).alias("values"))
    whole = residual(F.lit("all"), "mean", "class_mean", "mean")
    classes = residual(F.concat(F.lit("class "), "cls"), "class_mean").where(F.col("n_class") >= LEAST_CLASS)
    pools = io.written(whole.unionAll(classes), "kriging")
    whole = pools.where("pool = 'all'")
    fields = pools.where("pool = 'all'").select("held", "pool", "id", "x", "y", F.posexplode(F.slice("values", 1, 2)).alias("field", "value"))
    fields = fields.unionAll(pools.where("pool <> 'all'").select("held", "pool", "id", "x", "y", F.lit(0).alias("field"), F.get("values", F.lit(0)).alias("value")))
    fitted = io.written(fit_sampled(fields, ["held", "pool", "field"]), "kriging")
    common = fitted.where("pool = 'all'").groupBy("held").agg(F.max(F.when(F.col("field") == 0, F.col("model"))).alias("m0"), F.max(F.when(F.col("field") == 1, F.col("model"))).alias("m1")).where("m0 is not null")
    own = fitted.where("pool <> 'all'").select("held", "pool", F.col("model").alias("own"))

    asked = rows.withColumnRenamed("fold", "held").join(F.broadcast(known.select("held", "mean").distinct().join(common, "held")), "held")
    moved = io.written(window_models(asked.select("held", "id", "x", "y", "m0", "m1"), whole.select("held", "id", "x", "y", F.get("values", F.lit(0)).alias("value")), "held", k), "kriging")
    to_all = moved.select("held", F.lit("all").alias("pool"), "id", "x", "y", F.array("m0", F.coalesce("m1", "m0"), "moving").alias("models"))
    to_class = asked.withColumn("pool", F.concat(F.lit("class "), "cls")).join(F.broadcast(own), ["held", "pool"]).select("held", "pool", "id", "x", "y", F.array("own").alias("models"))
    got = io.written(local_kriging(to_all.unionAll(to_class), pools, ["held", "pool"], k), "kriging")
    estimate = lambda n: F.get("estimates", F.lit(n))
    common_of = got.where("pool = 'all'").select("held", "id", *[estimate(n).alias(f"e{n}") for n in range(3)])
    class_of = got.where("pool <> 'all'").select("held", "id", estimate(0).alias("e3"))
    drift = F.coalesce("class_mean", "mean")
    both = asked.join(common_of, ["held", "id"]).join(class_of, ["held", "id"], "left").join(known.drop("mean", "n_class"), ["held", "cls"], "left")
    out = [F.col("mean") + F.col("e0"), drift + F.col("e1"), F.col("mean") + F.col("e2"), F.coalesce(F.col("class_mean") + F.col("e3"), drift + F.col("e1"))]
    return both.select(F.col("held").alias("fold"), "id", "value", *[e.alias(m) for e, m in zip(out, METHODS, strict=True)])


def block_cv(points: DataFrame, n_blocks: int = 4, sample: int = 0, seed: int = 0, k: int = 48) -> DataFrame:
    """fold, method, rmse, n of `block_predictions`."""
    long = block_predictions(points, n_blocks, sample, seed, k).unpivot(["fold", "id", "value"], list(METHODS), "method", "guess")
    return long.groupBy("fold", "method").agg(F.sqrt(F.avg((F.col("guess") - F.col("value")) ** 2)).alias("rmse"), F.count("*").alias("n"))


def cv_summary(scores: DataFrame) -> DataFrame:
    """method, mean_rmse, std_rmse, folds, wins: folds in which it is better than the global method."""
    base = F.max(F.when(F.col("method") == "global", F.col("rmse"))).over(Window.partitionBy("fold"))
    known = scores.withColumn("base", base).where("base is not null")
    won: Column = F.count(F.when(F.col("rmse") < F.col("base"), 1))
    return known.groupBy("method").agg(F.avg("rmse").alias("mean_rmse"), F.stddev_pop("rmse").alias("std_rmse"), F.count("*").alias("folds"), won.alias("wins"))
