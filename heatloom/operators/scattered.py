"""Linear interpolation of scattered points: for each target the Delaunay triangle that holds it, found tile by tile with a proof that no farther point changes it.

Of all triangles of points around a target, the Delaunay triangle has the least weighted sum of squared distances (weights: the target's barycentric
coordinates). That is a linear programme with three equations; its simplex steps are taken for all targets of a tile at once. The triangle's circumcircle holds no point of
those looked at. If it lies inside the region whose points are all there, it is empty for good; otherwise the target goes to the next round with a region twice
as wide. The corners of all points' convex hull take part everywhere, so what no triangle holds lies outside, and takes the nearest point.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.functions import columns as C
from heatloom.sources import io

#: Points of a tile, about; matrix cells that a task holds at a time; simplex steps after which something is wrong.
PER_TILE, AT_ONCE, STEPS = 64, 1 << 21, 2_000


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of points (rows x, y), without those on its edges."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def chain(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(points) + chain(points[::-1]))


def hull_corners(places: DataFrame) -> np.ndarray:
    """The corners of the hull of all places (px, py): of each task's, then of those together."""

    def corners(batches):
        kept = np.zeros((0, 2))
        for pdf in batches:
            kept = hull(np.concatenate([kept, pdf.to_numpy()]))
        yield pd.DataFrame(kept, columns=["px", "py"])

    # few of many places are corners, and only corners of tasks meet in one
    found = places.select("px", "py").mapInPandas(corners, "px double, py double").coalesce(1).mapInPandas(corners, "px double, py double")
    return found.toPandas().to_numpy()


def spread(points: np.ndarray) -> np.ndarray:
    """A number in 0 to 1 that depends on a point's coordinates alone."""
    bits = np.ascontiguousarray(points, np.float64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (bits[:, 0] ^ (bits[:, 1] >> np.uint64(7))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(11)).astype(np.float64) / 2**53


def triangles(points: np.ndarray, targets: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each target: corners (numbers of points; -1 where no triangle holds it), weights, centre and radius of the circle through them.

    `width` is the size of the whole field, in which all lengths are measured. Points on one circle are told apart by a tiny change that depends on the point alone, and targets on
    an edge by one that depends on the target, so the result is the same in every tile.
    """
    m, n = len(targets), len(points)
    jitter = 1e-9 * (spread(targets)[:, None] - 0.5) * np.array([[1.0, 0.6180339887498949]])
    q = targets / width + jitter
    ghosts = 4.0 * np.array([[0.0, 1.0], [-0.9, -0.5], [0.9, -0.5]])  # corners around any target, dearer than all points
    x = np.concatenate([points[None, :, 0] / width - q[:, :1], np.tile(ghosts[:, 0], (m, 1))], axis=1)
    y = np.concatenate([points[None, :, 1] / width - q[:, 1:], np.tile(ghosts[:, 1], (m, 1))], axis=1)
    cost = np.concatenate([x[:, :n] ** 2 + y[:, :n] ** 2 + 1e-10 * spread(points)[None, :], np.full((m, 3), 1e6)], axis=1)
    basis = np.tile(np.arange(n, n + 3), (m, 1))
    plane = np.zeros((m, 3))
    busy = np.arange(m)
    for _ in range(STEPS):
        own = basis[busy]
        rows = np.stack([np.take_along_axis(x[busy], own, 1), np.take_along_axis(y[busy], own, 1), np.ones(own.shape)], axis=1)
        plane[busy] = np.linalg.solve(rows.transpose(0, 2, 1), np.take_along_axis(cost[busy], own, 1)[..., None])[..., 0]
        a, b, c = plane[busy].T[..., None]
        gain = cost[busy] - (a * x[busy] + b * y[busy] + c)
        np.put_along_axis(gain, own, np.inf, 1)
        enter = gain.argmin(1)
        k = np.arange(len(busy))
        better = gain[k, enter] < -1e-13
        if not better.any():
            break
        busy, k, enter, rows = busy[better], k[better], enter[better], rows[better]
        new = np.stack([x[busy, enter], y[busy, enter], np.ones(len(busy))], axis=1)
        both = np.linalg.solve(rows, np.stack([np.tile([0.0, 0.0, 1.0], (len(busy), 1)), new], axis=2))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(both[..., 1] > 1e-14, np.maximum(both[..., 0], 0) / both[..., 1], np.inf)
        basis[busy, ratio.argmin(1)] = enter
    else:
        raise RuntimeError("the search for a triangle didn't end")
    rows = np.stack([np.take_along_axis(x, basis, 1), np.take_along_axis(y, basis, 1), np.ones(basis.shape)], axis=1)
    weights = np.linalg.solve(rows, np.tile([[0.0], [0.0], [1.0]], (m, 1, 1)))[..., 0] if m else np.zeros((0, 3))
    outside = (basis >= n).any(1)
    centre = (q + plane[:, :2] / 2) * width
    radius = np.sqrt(np.maximum(plane[:, 2] + (plane[:, :2] ** 2).sum(1) / 4, 0)) * width
    return np.where(outside[:, None], -1, basis), weights, centre, radius


def interpolate_linear(points: DataFrame, cells: DataFrame, features: list[str], per_tile: int = PER_TILE) -> DataFrame:
    """y, x and the features of cells (y, x, lat, lon), linear in the Delaunay triangles of points (lat, lon, features), of the nearest point outside; what is left null takes the feature's mean over the cells.

    A triangle with a corner without a value gives none, and the nearest point's stands in. Points at one place are one point with their mean; points and cells
    without a finite place take no part (such cells have the mean). Points on one line have no triangle. No points give nulls. A group is a tile's cells and the points of
    its region: about per_tile points for each of the region's tiles where points are spread evenly.
    """
    spark = points.sparkSession
    at = lambda c: C.finite(F.col(c).cast("double"))
    places = points.select(at("lon").alias("px"), at("lat").alias("py"), *[at(c).alias(c) for c in features]).where("px is not null and py is not null")
    places = places.groupBy("px", "py").agg(*[F.avg(c).alias(c) for c in features])
    path = io.scratch(spark, "places")
    places.write.parquet(path)
    places = spark.read.schema(places.schema).parquet(path)
    n, x0, x1, y0, y1 = places.agg(F.count("*"), F.min("px"), F.max("px"), F.min("py"), F.max("py")).first()
    wanted = cells.select("y", "x", at("lon").alias("qx"), at("lat").alias("qy"))
    empty = [F.lit(None).cast("double").alias(c) for c in features]
    if not n:
        return wanted.select("y", "x", *empty)
    width = max(x1 - x0, y1 - y0) or 1.0
    side = width / max(1.0, np.ceil((n / per_tile) ** 0.5))
    corners = hull_corners(places)
    last = int(max(x1 - x0, y1 - y0) // side) + 1
    tile = lambda v, low: F.floor((F.col(v) - low) / side).cast("int")
    # a cell outside the points' box belongs to the tile next to it
    inside = lambda c: F.least(F.greatest(c, F.lit(-1)), F.lit(last))
    todo = wanted.where("qx is not null and qy is not null").withColumns({"tx": inside(tile("qx", x0)), "ty": inside(tile("qy", y0))})
    schema = "y int, x int, tx int, ty int, qx double, qy double, done boolean, " + ", ".join(f"`{c}` double" for c in features)
    parts, margin = [], 1
    while True:
        everything = margin > last

        def solve(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            if not len(q):
                return pd.DataFrame(columns=[c.split()[0].strip("`") for c in schema.split(", ")])
            known = p[["px", "py"]].to_numpy(float)
            values = p[features].to_numpy(float)
            more = corners[~(corners[:, None, :] == known[None, :, :]).all(2).any(1)] if len(known) else corners
            own, targets = np.concatenate([known, more]), q[["qx", "qy"]].to_numpy(float)
            values = np.concatenate([values, np.full((len(more), len(features)), np.nan)])
            low = np.array([x0 + (q.tx.iloc[0] - margin) * side, y0 + (q.ty.iloc[0] - margin) * side])
            high = low + (2 * margin + 1) * side
            out, done = np.full((len(q), len(features)), np.nan), np.zeros(len(q), bool)
            step = max(1, AT_ONCE // max(1, len(own)))
            for a in range(0, len(q), step):
                t = targets[a : a + step]
                which, weights, centre, radius = triangles(own, t, width)
                outside = which[:, 0] < 0
                proven = everything | ((centre - radius[:, None] >= low) & (centre + radius[:, None] <= high)).all(1)
                proven &= outside | (which < len(known)).all(1)  # a hull corner's value is known only where it is a point of the region
                got = np.where(outside[:, None], np.nan, np.einsum("ij,ijk->ik", weights, values[which]))
                if len(known):
                    d2 = ((known[None, :, :] - t[:, None, :]) ** 2).sum(2)
                    close = np.lexsort((np.broadcast_to(known[:, 0], d2.shape), np.broadcast_to(known[:, 1], d2.shape), d2))[:, 0]
                    reach = np.sqrt(d2[np.arange(len(t)), close])[:, None]
                    near_proven = everything | ((t - reach >= low) & (t + reach <= high)).all(1)
                    need = np.isnan(got).any(1)
                    got = np.where(np.isnan(got), values[close], got)
                    done[a : a + step] = np.where(outside, near_proven, proven & (~need | near_proven))
                out[a : a + step] = got
            return pd.concat([q[["y", "x", "tx", "ty", "qx", "qy"]].reset_index(drop=True), pd.DataFrame({"done": done}), pd.DataFrame(out, columns=features)], axis=1)

        steps = F.sequence(F.lit(-margin), F.lit(margin))
        near = places.withColumn("tx", F.explode(F.transform(steps, lambda s: tile("px", x0) + s))).withColumn("ty", F.explode(F.transform(steps, lambda s: tile("py", y0) + s)))
        near = near.join(todo.select("tx", "ty").distinct(), ["tx", "ty"], "left_semi")
        solved = near.groupBy("tx", "ty").cogroup(todo.groupBy("tx", "ty")).applyInPandas(solve, schema)
        path = io.scratch(spark, "interpolated")
        solved.write.parquet(path)
        solved = spark.read.schema(schema).parquet(path)
        parts.append(solved.where("done").select("y", "x", *features))
        todo = solved.where("not done").select("y", "x", "qx", "qy", "tx", "ty")
        if everything or todo.isEmpty():
            break
        margin *= 2
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = found.unionByName(wanted.where("qx is null or qy is null").select("y", "x", *empty))
    means = F.broadcast(found.agg(*[F.avg(C.finite(F.col(c))).alias(f"__{c}") for c in features]))
    return found.crossJoin(means).select("y", "x", *[F.coalesce(C.finite(F.col(c)), F.col(f"__{c}")).alias(c) for c in features])
