"""Grids: nearest cells, bilinear and inverse-distance weights, upsampling, tiles and mosaics, filling and repair."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatloom.functions import columns as C
from heatloom.operators import ranges
from heatloom.operators.audit import even_sample
from heatloom.operators.nearest import nearest
from heatloom.operators.verify import split_metrics


def nearest_on_axis(points: DataFrame, axis: DataFrame, value: str, index: str) -> DataFrame:
    """points with `index` of the axis (index, value) entry nearest to `value`; the lowest index of equal ones. Axes are short; the search is a sorted array's.
    """
    packed = F.broadcast(axis.agg(F.array_sort(F.collect_list(F.struct("value", "index"))).alias("__axis")))
    near = F.array_min(F.transform("__axis", lambda a: F.struct(F.abs(a["value"] - F.col(value)).alias("d"), a["index"].alias("i"))))
    return points.crossJoin(packed).withColumn(index, near["i"]).drop("__axis")


def nearest_cell(stations: DataFrame, lats: DataFrame, lons: DataFrame) -> DataFrame:
    """stations with y and x of the cell whose latitude and longitude are nearest, axis by axis."""
    return nearest_on_axis(nearest_on_axis(stations, lats, "lat", "y"), lons, "lon", "x")


def axis_weights(points: DataFrame, axis: DataFrame, value: str, out: str) -> DataFrame:
    """points with an array `out` of (index, weight): the two axis entries around value, clamped to the axis. Either direction of the axis will do."""
    packed = F.broadcast(axis.agg(F.array_sort(F.collect_list(F.struct("value", "index"))).alias("__axis")))
    n = F.size("__axis")
    below = F.size(F.filter("__axis", lambda a: a["value"] < F.col(value))) - 1
    i = F.greatest(F.lit(0), F.least(below, n - 2))
    a, b = F.get("__axis", i), F.get("__axis", i + 1)
    part = C.clip((F.col(value) - a["value"]) / (b["value"] - a["value"]), 0, 1)
    pair = F.when(n == 1, F.array(F.struct(F.get("__axis", F.lit(0))["index"].alias("i"), F.lit(1.0).alias("w")))).otherwise(
        F.array(F.struct(a["index"].alias("i"), (1 - part).alias("w")), F.struct(b["index"].alias("i"), part.alias("w")))
    )
    return points.crossJoin(packed).withColumn(out, pair).drop("__axis")


def bilinear_weights(stations: DataFrame, lats: DataFrame, lons: DataFrame, key: str = "station_id") -> DataFrame:
    """key, y, x, w: up to four cells of each station."""
    both = axis_weights(axis_weights(stations, lats, "lat", "__y"), lons, "lon", "__x")
    cells = both.select(key, F.explode("__y").alias("a"), "__x").select(key, "a", F.explode("__x").alias("b"))
    return cells.select(key, F.col("a.i").alias("y"), F.col("b.i").alias("x"), (F.col("a.w") * F.col("b.w")).alias("w"))


def weighted_extract(grid: DataFrame, weights: DataFrame, value: str, by: list[str], key: str = "station_id", whole: bool = False) -> DataFrame:
    """by, key, value: the weighted mean of the grid's cells with a value. The join keeps only wanted cells before anything is grouped.

    With `whole` (bilinear weights) a value is null unless all of a station's cells have one, also where a weight is 0; otherwise (footprints) the weights that are left are divided by.
    """
    v = C.finite(F.col(value))
    if not whole:
        return grid.join(weights, ["y", "x"]).where(v.isNotNull()).groupBy(*by, key).agg(F.try_divide(F.sum(v * F.col("w")), F.sum("w")).alias(value))
    needed = weights.groupBy(key).agg(F.count("*").alias("__n"), F.collect_list(F.struct("y", "x", "w")).alias("__c")).select(key, "__n", F.explode("__c").alias("__c")).select(key, "__n", "__c.*")
    out = grid.join(needed, ["y", "x"]).groupBy(*by, key).agg(F.sum(v * F.col("w")).alias(value), F.count(v).alias("__k"), F.first("__n").alias("__n"))
    return out.select(*by, key, F.when(F.col("__k") == F.col("__n"), F.col(value)).alias(value))


def footprint_weights(stations: DataFrame, radius: int, sigma: float, key: str = "station_id") -> DataFrame:
    """key, y, x, w: cells within `radius` of the station's cell (y, x), with Gaussian weights."""
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    cells = stations.withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    d2 = F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")
    return cells.where(d2 <= radius * radius).select(key, (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), F.exp(-d2 / (2.0 * sigma * sigma)).alias("w"))


def nearest_stations(cells: DataFrame, stations: DataFrame, k: int, power: float) -> DataFrame:
    """y, x, station_id, w: weights 1 / d^power of the k nearest stations (degrees), summing to 1; found by squares (see nearest)."""
    distance = lambda d2: F.greatest(F.sqrt(d2), F.lit(1e-9))
    near = nearest(cells.select("y", "x", "lat", "lon"), ["y", "x"], stations.select("station_id", "lat", "lon"), ["station_id"], k, distance)
    raw = 1 / F.pow(distance(F.col("d2")), F.lit(power))
    return near.select("y", "x", "station_id", (raw / F.sum(raw).over(Window.partitionBy("y", "x"))).alias("w"))


def idw(obs: DataFrame, stations: DataFrame, cells: DataFrame, k: int = 12, power: float = 2.0) -> DataFrame:
    """time, y, x, t_c by inverse distance; a station without a value takes its hour's mean over stations, or 0 if none has one."""
    weights = nearest_stations(cells, stations, k, power)
    v = C.finite(F.col("obs_c"))
    means = obs.groupBy("time").agg(F.avg(v).alias("__mean"))
    full = stations.select("station_id").crossJoin(F.broadcast(means))  # hours x stations: the full series; a row an hour travels
    known = obs.select("time", "station_id", v.alias("obs_c")).hint("merge")  # readings, stations and cells are many: none goes to every task
    filled = full.join(known, ["time", "station_id"], "left").withColumn("obs_c", F.coalesce("obs_c", "__mean", F.lit(0.0)))
    return filled.join(weights.hint("merge"), "station_id").groupBy("time", "y", "x").agg(F.sum(F.col("w") * F.col("obs_c")).alias("t_c"))


def points_to_grid(points: DataFrame, cells: DataFrame, features: list[str]) -> DataFrame:
    """y, x and the features of the nearest point (lat, lon, in degrees), of equal ones that with the smaller lat and lon; nulls, and cells without a place, take the feature's mean."""
    p = points.select("lat", "lon", F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), *features)
    near = nearest(cells.select("y", "x", "lat", "lon"), ["y", "x"], p, ["__lat", "__lon"]).select("y", "x", *features)
    lost = cells.where(C.finite(F.col("lat")).isNull() | C.finite(F.col("lon")).isNull()).select("y", "x")
    near = near.unionByName(lost, allowMissingColumns=True)
    means = F.broadcast(near.agg(*[F.avg(C.finite(F.col(c))).alias(f"__{c}") for c in features]))
    return near.crossJoin(means).select("y", "x", *[F.coalesce(C.finite(F.col(c)), F.col(f"__{c}")).alias(c) for c in features])


def station_mask(cells: DataFrame, stations: DataFrame) -> DataFrame:
    """cells (y, x, lat, lon) with mask 1 for the cell nearest to a station; lowest (y, x) of equal ones."""
    own = nearest(stations.select("station_id", "lat", "lon"), ["station_id"], cells.select("y", "x", "lat", "lon"), ["y", "x"])
    return cells.join(own.select("y", "x").distinct().withColumn("mask", F.lit(1)), ["y", "x"], "left").withColumn("mask", F.coalesce("mask", F.lit(0)))


def asof_next(times: DataFrame, requested: DataFrame) -> DataFrame:
    """requested (req) with time: the first available one at or after it, or the last one. Both lists are merged by ranges of time; what a range lacks, the first of the next ones has."""
    both = times.select(F.col("time").alias("t"), F.lit(None).cast("timestamp").alias("req")).distinct().unionByName(requested.select(F.col("req").alias("t"), "req").distinct())
    available = F.when(F.col("req").isNull(), F.col("t"))
    found = ranges.next_or_own(both, available, ["t", F.col("req").isNull().cast("int")], ["t"], "next").where("req is not null").select("req", "next")
    last = F.broadcast(times.agg(F.max("time").alias("__last")))
    return requested.join(found, "req").crossJoin(last).withColumn("time", F.coalesce("next", "__last")).drop("next", "__last")


def append_climatology(static: DataFrame, clim: DataFrame, name: str = "climatology") -> DataFrame:
    """static with clim (y, x, value) as one more column if both have the same cells; unchanged otherwise."""
    count = lambda d, n: d.groupBy("y", "x").agg(F.count("*").alias(n))
    both = count(static, "n").join(count(clim, "m"), ["y", "x"], "full_outer")
    if not both.where("n is null or m is null or n <> m").isEmpty():
        return static
    return static.join(clim.select("y", "x", F.col("value").alias(name)), ["y", "x"])


def axis_table(spark, n_out: int, n_in: int, method: str) -> DataFrame:
    """out, i, w: source entries of each target index, with half-pixel centres."""
    at = (F.col("out") + 0.5) * (n_in / n_out) - 0.5
    base = spark.range(n_out).select(F.col("id").cast("int").alias("out"))
    if method == "nearest":
        return base.select("out", F.least(F.floor((F.col("out") + 0.5) * (n_in / n_out)).cast("int"), F.lit(n_in - 1)).alias("i"), F.lit(1.0).alias("w"))
    low = C.clip(at, 0, n_in - 1)
    a = F.floor(low).cast("int")
    pair = F.array(F.struct(a.alias("i"), (1 - (low - a)).alias("w")), F.struct(F.least(a + 1, F.lit(n_in - 1)).alias("i"), (low - a).alias("w")))
    return base.select("out", F.explode(pair).alias("p")).select("out", "p.i", "p.w").where("w > 0")


def upsample(lr: DataFrame, shape_in: tuple[int, int], shape_out: tuple[int, int], by: list[str], value: str, method: str = "bilinear") -> DataFrame:
    """by, y, x, value of frames (by, gy, gx, value) on a finer grid: the untrained baselines."""
    spark = lr.sparkSession
    rows = axis_table(spark, shape_out[0], shape_in[0], method).withColumnsRenamed({"out": "y", "i": "gy", "w": "wy"})
    cols = axis_table(spark, shape_out[1], shape_in[1], method).withColumnsRenamed({"out": "x", "i": "gx", "w": "wx"})
    fine = lr.join(F.broadcast(rows), "gy").join(F.broadcast(cols), "gx")  # a row or two for each index of an axis
    return fine.groupBy(*by, "y", "x").agg(F.sum(F.col("wy") * F.col("wx") * F.col(value)).alias(value))


def climatology(hr: DataFrame, value: str = "t_c") -> DataFrame:
    return hr.groupBy("y", "x").agg(F.avg(value).alias("value"))


def residual_map(hr: DataFrame, lr: DataFrame, shape_in: tuple[int, int], shape_out: tuple[int, int], value: str = "t_c") -> DataFrame:
    """y, x, value: the fine field's mean over time (y, x, value) less the coarse one's (gy, gx, value), which is brought to the fine grid after its mean is taken, so little is upsampled."""
    coarse = lr.groupBy("gy", "gx").agg(F.avg(C.finite(F.col(value))).alias(value))
    up = upsample(coarse, shape_in, shape_out, [], value).withColumnRenamed(value, "__up")
    fine = hr.groupBy("y", "x").agg(F.avg(C.finite(F.col(value))).alias("value"))
    return fine.join(up, ["y", "x"]).select("y", "x", (F.col("value") - F.col("__up")).alias("value"))


def error_map(df: DataFrame, cells: DataFrame, pred: str = "pred_c", ref: str = "t_c") -> DataFrame:
    """y, x, value: mean absolute error of each cell, 0 where nothing is known."""
    known = df.groupBy("y", "x").agg(F.avg(F.abs(F.col(pred) - F.col(ref))).alias("value"))
    return cells.select("y", "x").distinct().join(known, ["y", "x"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def hour_residuals(rows: DataFrame, hours: tuple[int, ...] = (3, 14), cell: tuple[str, ...] = ("y", "x"), least: int = 10) -> DataFrame:
    """hour, mae, bias, pred_mean, ref_mean, r2 of rows (hour, cell, pred_c, t_c, feature) at some hours of the day.

    r2 is that of a line through the cells' mean absolute errors over the feature (a cell's mean one), for at least `least` cells where both are finite.
    """
    d = F.col("pred_c") - F.col("t_c")
    wanted = rows.where(F.col("hour").isin(*hours)).withColumns({"__e": F.abs(d), "__d": d})
    cells = wanted.groupBy("hour", *cell).agg(
        F.avg("__e").alias("e"), F.avg("feature").alias("f"), F.sum("__e").alias("__se"), F.count("__e").alias("__ne"), F.sum("__d").alias("__sd"),
        *[x for c in ("pred_c", "t_c") for x in (F.sum(c).alias(f"__s_{c}"), F.count(c).alias(f"__n_{c}"))],
    )
    e, f = C.finite(F.col("e")), C.finite(F.col("f"))
    both = e.isNotNull() & f.isNotNull()
    line = F.when(F.count(F.when(both, 1)) >= least, F.regr_r2(F.when(both, e), F.when(both, f)))
    mean = lambda c: F.try_divide(F.sum(f"__s_{c}"), F.sum(f"__n_{c}"))
    mae, bias = (F.try_divide(F.sum(s), F.sum("__ne")) for s in ("__se", "__sd"))
    return cells.groupBy("hour").agg(mae.alias("mae"), bias.alias("bias"), mean("pred_c").alias("pred_mean"), mean("t_c").alias("ref_mean"), line.alias("r2"))


def overall_residuals(rows: DataFrame) -> DataFrame:
    """One row: bias, mae and rmse over rows of all hours (pred_c, t_c)."""
    e = F.col("pred_c") - F.col("t_c")
    return rows.agg(F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def day_night_delta(residuals: DataFrame, day: int = 14, night: int = 3) -> DataFrame:
    """One row with the night's figures less the day's, of hour_residuals."""
    at = lambda c, h: F.max(F.when(F.col("hour") == h, F.col(c)))
    return residuals.agg(*[(at(c, night) - at(c, day)).alias(f"delta_{c}") for c in ("mae", "bias", "pred_mean", "ref_mean", "r2")])


def tile_grid(frames: DataFrame, patch: int = 96, stride: int = 48) -> DataFrame:
    """frames (h, w, more) with y0, x0: a row for each regular tile, the last ones flush with the edges."""

    def starts(size: str) -> Column:
        last = F.greatest(F.col(size) - patch, F.lit(0)).cast("int")
        return F.array_sort(F.array_union(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))

    return frames.withColumn("y0", F.explode(starts("h"))).withColumn("x0", F.explode(starts("w")))


def hann(i: Column, n: int) -> Column:
    return 0.5 - 0.5 * F.cos(2 * math.pi * i / (n - 1)) if n > 1 else F.lit(1.0)


def mosaic(tiles: DataFrame, patch: int, by: list[str] = ("time",), value: str = "value") -> DataFrame:
    """by, y, x, value: the mean of overlapping tiles (y0, x0, dy, dx, value) with the outer product of Hann windows, at least 1e-6, as weights."""
    w = F.greatest(hann(F.col("dy"), patch) * hann(F.col("dx"), patch), F.lit(1e-6))
    cells = tiles.select(*by, (F.col("y0") + F.col("dy")).alias("y"), (F.col("x0") + F.col("dx")).alias("x"), (w * F.col(value)).alias("wv"), w.alias("w"))
    return cells.groupBy(*by, "y", "x").agg((F.sum("wv") / F.sum("w")).alias(value))


def frame_correlation(df: DataFrame, by: str = "time", a: str = "pred_c", b: str = "t_c") -> DataFrame:
    """by, r and is_anomaly: frames whose correlation is over two population deviations below the mean."""
    rows = df.groupBy(by).agg(C.corr(a, b).alias("r"))
    stats = F.broadcast(rows.agg(F.avg("r").alias("m"), F.stddev_pop("r").alias("s")))
    return rows.crossJoin(stats).select(by, "r", (F.col("r") < F.col("m") - 2 * F.col("s")).alias("is_anomaly"))


def orientations(h: int, w: int) -> dict[str, tuple[Column, Column]]:
    """Where the cell (y, x) of a square frame goes in each variant, in the order in which equal ones are preferred. The flipped transposes are rotations under another name."""
    y, x = F.col("y"), F.col("x")
    return {
        "as_is": (y, x), "rot90": (w - 1 - x, y), "rot180": (h - 1 - y, w - 1 - x), "rot270": (x, h - 1 - y), "flip_y": (h - 1 - y, x), "flip_x": (y, w - 1 - x),
        "transpose": (x, y), "transpose_flip_y": (w - 1 - x, y), "transpose_flip_x": (x, h - 1 - y),
    }


def orientation_score(a: DataFrame, b: DataFrame, n: int, by: list[str] = ()) -> DataFrame:
    """by, variant, r, is_best: correlation of each turned or mirrored square frame a with b (by, y, x, value). The best is the first of those with the largest r (to 9 digits)."""
    ways = orientations(n, n)
    moved = F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), yy.cast("int").alias("y2"), xx.cast("int").alias("x2")) for k, (yy, xx) in ways.items()]))
    turned = a.select(*by, F.col("value").alias("a"), moved.alias("m")).select(*by, "a", "m.variant", F.col("m.y2").alias("y"), F.col("m.x2").alias("x"))
    scores = turned.join(b.withColumnRenamed("value", "b"), [*by, "y", "x"]).groupBy(*by, "variant").agg(C.corr("a", "b").alias("r"))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last(F.round("r", 9)), F.array_position(F.array(*map(F.lit, ways)), F.col("variant"))))
    return scores.withColumn("is_best", first == 1)


def stride_grid(df: DataFrame, step: int, y: str = "y", x: str = "x") -> DataFrame:
    return df.where((F.col(y) % step == 0) & (F.col(x) % step == 0))


def downsample(df: DataFrame, max_size: int = 160) -> DataFrame:
    """Every step-th row and column, so that neither side is longer than max_size."""
    size = F.broadcast(df.agg(F.ceil(F.greatest(F.max("y") + 1, F.max("x") + 1) / max_size).alias("__s")))
    return df.crossJoin(size).where((F.col("y") % F.col("__s") == 0) & (F.col("x") % F.col("__s") == 0)).drop("__s")


def nearest_fill(df: DataFrame, value: str, axis: str, within: list[str]) -> DataFrame:
    """Nulls take the nearest value along `axis` of the same `within`, the lower side of equal ones; a line without values keeps its nulls."""
    v = C.finite(F.col(value))
    down = Window.partitionBy(*within).orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(*within).orderBy(axis).rowsBetween(0, Window.unboundedFollowing)
    at = F.col(axis).cast("double") if axis != "time" else F.unix_timestamp(axis).cast("double")
    known = F.when(v.isNotNull(), F.struct(at.alias("i"), v.alias("v")))
    rows = df.withColumns({"__lo": F.last(known, True).over(down), "__hi": F.first(known, True).over(up)})
    low_near = F.col("__hi").isNull() | (at - F.col("__lo.i") <= F.col("__hi.i") - at)
    return rows.withColumn(value, F.when(F.col("__lo").isNotNull() & low_near, F.col("__lo.v")).otherwise(F.col("__hi.v"))).drop("__lo", "__hi")


def fill_grid(df: DataFrame, value: str, by: list[str] = ("variable",), axes: tuple[str, ...] = ("x", "y", "time")) -> DataFrame:
    """Passes of nearest_fill along the axes in turn; what is left takes its variable's mean, and a variable without values is 0.

    Coarse inputs take all three axes; a fine field has no time pass and one mean: axes=("x", "y"), by=[].
    """
    others = {"x": ["time", "y"], "y": ["time", "x"], "time": ["y", "x"]}
    for axis in axes:
        df = nearest_fill(df, value, axis, [*by, *others[axis]])
    means = F.broadcast(df.groupBy(*by).agg(F.avg(value).alias("__m")))
    return (df.join(means, list(by)) if by else df.crossJoin(means)).withColumn(value, F.coalesce(value, "__m", F.lit(0.0))).drop("__m")  # a row a variable


def directional_fill(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """Nulls take the value before, then the one after, along x and then along y."""
    for axis, other in (("x", "y"), ("y", "x")):
        w = Window.partitionBy(*by, other).orderBy(axis)
        v = C.finite(F.col(value))
        before = F.last(v, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        after = F.first(v, True).over(w.rowsBetween(0, Window.unboundedFollowing))
        df = df.withColumn(value, F.coalesce(before, after))
    return df


def temporal_jump(df: DataFrame, by: list[str] = (), value: str = "value") -> DataFrame:
    """by, time, max_jump: the largest change of a cell since its row before."""
    jump = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(*by, "y", "x").orderBy("time")))
    return df.withColumn("__j", jump).groupBy(*by, "time").agg(F.max("__j").alias("max_jump"))


def gaussian_kernel(sigma: float, radius: int) -> np.ndarray:
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return k / k.sum()


def smooth(frame: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Separable filter with mirrored edges (the edge value repeated)."""
    r = len(kernel) // 2
    for axis in (0, 1):
        padded = np.pad(frame, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        frame = np.apply_along_axis(lambda line: np.convolve(line, kernel[::-1], "valid"), axis, padded)
    return frame


def frame_of(pdf: pd.DataFrame, value: str) -> np.ndarray:
    out = np.full((int(pdf.y.max()) + 1, int(pdf.x.max()) + 1), np.nan)
    out[pdf.y, pdf.x] = pdf[value]
    return out


def values_at(frame: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The frame's values at some cells; NaN outside it."""
    inside, out = (y < frame.shape[0]) & (x < frame.shape[1]), np.full(len(y), np.nan)
    out[inside] = frame[y[inside], x[inside]]
    return out


def repair_nan(df: DataFrame, value: str = "value", sigma: float = 1.0) -> DataFrame:
    """y, x, time, value, repaired_by: a bad cell takes the mean of the frames before and after it, else a Gaussian mean of its zero-filled frame.

    Frames are repaired in order of time: the one before is taken as repaired, the one after as it came; the first and the last have the spatial step alone. A
    frame with bad cells that were bad in the frame before too waits for that one, so such frames make a run that one task repairs in order; runs are short.
    Frames whose bad cells are good before and after stay in Spark's own operators.
    """
    v = C.finite(F.col(value))
    w = Window.partitionBy("y", "x").orderBy("time")
    a, b = F.lag(v).over(w), F.lead(v).over(w)
    rows = df.select("y", "x", "time", v.alias(value), a.alias("__a"), b.alias("__b"))
    bad, has_next = F.col(value).isNull(), F.col("__b").isNotNull()
    frames = rows.groupBy("time").agg(F.bool_or(bad & F.col("__a").isNull() & has_next).alias("waits"), F.bool_or(bad & (F.col("__a").isNull() | ~has_next)).alias("holes"))
    order = Window.orderBy("time")  # a row a frame
    frames = frames.withColumn("edge", F.lag("time").over(order).isNull() | F.lead("time").over(order).isNull()).withColumn("holes", F.col("holes") | (F.col("edge") & F.col("waits")))
    frames = frames.withColumn("run", F.sum((~(F.col("waits") & ~F.col("edge"))).cast("int")).over(order))
    frames = frames.withColumn("ordered", F.max("holes").over(Window.partitionBy("run")) | (F.count("*").over(Window.partitionBy("run")) > 1))
    known = rows.join(frames.select("time", "edge", "run", "ordered"), "time")
    kernel = gaussian_kernel(sigma, int(4 * sigma + 0.5))

    def fix(pdf: pd.DataFrame) -> pd.DataFrame:
        out, before = [], None
        for _, own in sorted(pdf.groupby("time")):
            own = own.copy()
            frame = frame_of(own, value)
            hole, by = own[value].isna().to_numpy(), np.full(len(own), "none", object)
            prev = values_at(before, own.y.to_numpy(), own.x.to_numpy()) if before is not None else own["__a"].to_numpy(float)
            mean = (prev + own["__b"].to_numpy(float)) / 2
            timely = hole & np.isfinite(mean) & ~own.edge.to_numpy(bool)
            frame[own.y[timely], own.x[timely]] = mean[timely]
            left = hole & ~timely
            smoothed = smooth(np.nan_to_num(frame), kernel)
            frame[own.y[left], own.x[left]] = smoothed[own.y[left], own.x[left]]
            by[timely], by[left] = "time", "space"
            own[value], own["repaired_by"] = frame[own.y, own.x], by
            before = frame
            out.append(own[["y", "x", "time", value, "repaired_by"]])
        return pd.concat(out)

    kinds = df.schema
    schema = f"y {kinds['y'].dataType.simpleString()}, x {kinds['x'].dataType.simpleString()}, time {kinds['time'].dataType.simpleString()}, {value} double, repaired_by string"
    fixed = known.where("ordered").groupBy("run").applyInPandas(fix, schema)
    mean = (F.col("__a") + F.col("__b")) / 2
    rest = known.where(~F.col("ordered")).select("y", "x", "time", F.coalesce(value, mean).alias(value), F.when(bad, "time").otherwise("none").alias("repaired_by"))
    return rest.unionByName(fixed)


def ssim_value(a: np.ndarray, b: np.ndarray, sigma: float = 1.5, size: int = 11) -> float | None:
    """Structural similarity with a Gaussian window, over the windows inside the frame; the range is that of b."""
    span = np.nanmax(b) - np.nanmin(b)
    if not span > 0 or min(a.shape) < size:
        return None
    k = gaussian_kernel(sigma, size // 2)

    def mean(f: np.ndarray) -> np.ndarray:
        rows = np.apply_along_axis(lambda line: np.convolve(line, k, "valid"), 0, f)
        return np.apply_along_axis(lambda line: np.convolve(line, k, "valid"), 1, rows)

    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    ma, mb = mean(a), mean(b)
    va, vb, cov = mean(a * a) - ma * ma, mean(b * b) - mb * mb, mean(a * b) - ma * mb
    return float(np.mean((2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))))


def ssim(df: DataFrame, by: list[str], pred: str = "pred_c", ref: str = "t_c") -> DataFrame:
    """by, ssim of each frame; null where the reference is flat or the frame is under 11 cells wide."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, ssim_value(frame_of(pdf, pred), frame_of(pdf, ref))]], columns=[*by, "ssim"])

    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in by) + ", ssim double"
    return df.select(*by, "y", "x", pred, ref).groupBy(*by).applyInPandas(one, schema)


def split_report(df: DataFrame, frames: int = 50, pred: str = "pred_c", ref: str = "t_c") -> DataFrame:
    """One row: MAE, RMSE and MSE over all cells and times, and the mean similarity of at most `frames` evenly spaced frames."""
    times = even_sample(df, frames)
    similar = ssim(df.join(times, "time", "left_semi"), ["time"], pred, ref).agg(F.avg("ssim").alias("ssim"), F.count("ssim").alias("n_frames"))
    return split_metrics(df, pred, ref).crossJoin(similar)
