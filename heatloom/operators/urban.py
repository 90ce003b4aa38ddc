"""Buildings around stations: exact areas of polygons in discs."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge_areas(a: np.ndarray, b: np.ndarray, r: float) -> np.ndarray:
    """Signed areas between the origin and the edges a-b (rows x, y) inside a circle of radius r around it.

    A circle cuts an edge in at most two places, so each edge is three stretches, some empty; a stretch inside the circle adds a triangle, one outside a sector.
    """
    d = b - a
    length2 = (d * d).sum(1)
    there = length2 > 0
    safe = np.where(there, length2, 1.0)
    cross = a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]
    along, root = -(a * d).sum(1) / safe, r * r * length2 - cross * cross
    half = np.sqrt(np.maximum(root, 0)) / safe
    cuts = np.stack([np.zeros(len(a)), np.clip(along - half, 0, 1), np.clip(along + half, 0, 1), np.ones(len(a))], axis=1)
    ends = a[:, None, :] + cuts[:, :, None] * d[:, None, :]
    p, q = ends[:, :-1], ends[:, 1:]
    mid = a[:, None, :] + ((cuts[:, :-1] + cuts[:, 1:]) / 2)[:, :, None] * d[:, None, :]
    turn = p[..., 0] * q[..., 1] - p[..., 1] * q[..., 0]
    inside = (mid * mid).sum(2) <= r * r
    area = np.where(inside, turn / 2, r * r * np.arctan2(turn, (p * q).sum(2)) / 2)
    return np.where(there, area.sum(1), 0.0)


def disc_areas(xs: list, ys: list, cx: np.ndarray, cy: np.ndarray, r: float) -> np.ndarray:
    """Areas of simple polygons (arrays of corners' x and y) inside discs around centres: all edges of all polygons at once, as flat arrays with offsets."""
    sizes = np.array([len(v) for v in xs], np.int64)
    whose = np.repeat(np.arange(len(sizes)), sizes)
    if not len(whose):
        return np.zeros(len(sizes))
    corners = np.stack([np.concatenate(xs) - np.asarray(cx, float)[whose], np.concatenate(ys) - np.asarray(cy, float)[whose]], axis=1).astype(float)
    last = np.cumsum(sizes) - 1
    after = np.arange(1, len(whose) + 1)
    after[last[sizes > 0]] = (last - sizes + 1)[sizes > 0]
    return np.abs(np.bincount(whose, edge_areas(corners, corners[after], r), len(sizes)))


def disc_polygon_area(ring: np.ndarray, centre: tuple[float, float], r: float) -> float:
    """Area of a simple polygon inside a disc."""
    points = np.asarray(ring, float).reshape(-1, 2)
    return float(disc_areas([points[:, 0]], [points[:, 1]], np.array([centre[0]]), np.array([centre[1]]), r)[0])


def buffer_intersect(stations: DataFrame, buildings: DataFrame, radius: float = 150.0) -> DataFrame:
    """station_id, id, height_m, levels, inter_area_m2 of buildings (id, height_m, levels, ring of x, y) that a station's (x, y) disc meets.

    Both sides meet in squares of twice the radius, so each pair of a station and a building is tried once at most: in the square of the building's lower corner or of
    the disc's, whichever is further. Boxes are compared before the exact area, which is numpy's.
    """
    size = 2 * radius
    square = lambda c: F.floor(c / size).cast("bigint")
    span = lambda a, b: F.explode(F.sequence(square(a), square(b)))
    s = stations.select("station_id", F.col("x").alias("sx"), F.col("y").alias("sy"))
    s = s.withColumn("qx", span(F.col("sx") - radius, F.col("sx") + radius)).withColumn("qy", span(F.col("sy") - radius, F.col("sy") + radius))
    b = buildings.select("id", "height_m", "levels", "ring", *[f(F.col(f"ring.{c}")).alias(f"{c}{n}") for c in "xy" for n, f in (("a", F.array_min), ("b", F.array_max))])
    b = b.withColumn("qx", span(F.col("xa"), F.col("xb"))).withColumn("qy", span(F.col("ya"), F.col("yb")))
    pairs = s.join(b, ["qx", "qy"])
    first = (F.col("qx") == F.greatest(square(F.col("sx") - radius), square(F.col("xa")))) & (F.col("qy") == F.greatest(square(F.col("sy") - radius), square(F.col("ya"))))
    boxes = (F.col("xa") <= F.col("sx") + radius) & (F.col("xb") >= F.col("sx") - radius) & (F.col("ya") <= F.col("sy") + radius) & (F.col("yb") >= F.col("sy") - radius)
    corners = [F.col(f"ring.{c}").cast("array<double>").alias(f"__r{c}") for c in "xy"]
    near = pairs.where(first & boxes).select("station_id", "id", "height_m", "levels", "sx", "sy", *corners)

    def areas(batches):
        for pdf in batches:
            got = disc_areas(list(pdf["__rx"]), list(pdf["__ry"]), pdf.sx.to_numpy(), pdf.sy.to_numpy(), radius)
            yield pdf[["station_id", "id", "height_m", "levels"]].assign(inter_area_m2=got)

    types = {f.name: f.dataType.simpleString() for f in near.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in ("station_id", "id", "height_m", "levels")) + ", inter_area_m2 double"
    return near.mapInPandas(areas, schema).where("inter_area_m2 > 0")


def urban_metrics(intersections: DataFrame, stations: DataFrame, radius: float = 150.0) -> DataFrame:
    """station_id, total_built (at most the disc), avg_height by area, max_levels, buildings_in_buffer; zeros where nothing stands."""
    a = F.col("inter_area_m2")
    stats = intersections.groupBy("station_id").agg(
        F.least(F.sum(a), F.lit(math.pi * radius**2)).alias("total_built"), (F.sum(F.col("height_m") * a) / F.sum(a)).alias("avg_height"), F.max("levels").cast("double").alias("max_levels"), F.count("*").alias("buildings_in_buffer")
    )
    return stations.select("station_id").join(stats, "station_id", "left").na.fill(0.0, ["total_built", "avg_height", "max_levels"]).na.fill(0, ["buildings_in_buffer"])
