"""The k nearest places by squares against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heatloom.operators import grids
from heatloom.operators.nearest import nearest


def brute(points, places, k):
    out = set()
    for i, y, x in points:
        near = sorted(((y - b) ** 2 + (x - a) ** 2, j) for j, b, a in places)[:k]
        out |= {(i, j, n + 1) for n, (_, j) in enumerate(near)}
    return out


def frames(spark, points, places):
    return spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(places, "place long, lat double, lon double")


def spots(kind, rng, n):
    if kind == "even":
        at = rng.random((n, 2))
    elif kind == "clustered":  # two thirds in a spot a millionth as wide, and one far outlier
        at = np.concatenate([0.3 + 1e-6 * rng.random((2 * n // 3, 2)), rng.random((n - 2 * n // 3 - 1, 2)), [[50.0, -70.0]]])
    elif kind == "lattice":  # many ties
        at = np.stack(np.divmod(np.arange(n), 12), 1) * 0.5
    else:
        at = np.full((n, 2), 0.25)  # one spot
    return [(j, float(y), float(x)) for j, (y, x) in enumerate(at)]


@pytest.mark.parametrize("kind", ["even", "clustered", "lattice", "one spot"])
@pytest.mark.parametrize("k", [1, 5])
def test_nearest_equals_all_pairs(spark, kind, k):
    rng = np.random.default_rng(3)
    places = spots(kind, rng, 150)
    points = [(i, float(y), float(x)) for i, (y, x) in enumerate(np.concatenate([rng.random((40, 2)), 8 * rng.random((20, 2)) - 4, [[1e4, 3.0], [0.3, 0.3], [0.5, 0.5], [0.25, 0.25]]]))]
    a, b = frames(spark, points, places)
    got = nearest(a, ["id"], b, ["place"], k)
    assert {(r.id, r.place, r.n) for r in got.collect()} == brute(points, places, k)


def test_odd_rows_and_no_product(spark):
    a, b = frames(spark, [(0, 0.0, 0.0), (1, None, 0.0), (2, float("nan"), 1.0)], [(7, 1.0, 1.0), (8, None, 1.0), (9, 2.0, float("inf"))])
    assert [(r.id, r.place, r.d2, r.n) for r in nearest(a, ["id"], b, ["place"], 3).collect()] == [(0, 7, 2.0, 1)]
    assert nearest(a, ["id"], b.where("false"), ["place"], 3).isEmpty() and nearest(a.where("false"), ["id"], b, ["place"]).isEmpty()
    plan = nearest(a, ["id"], b, ["place"], 2)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_cells_without_a_place_take_the_mean(spark):
    cells = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 0.0, 1.0), (1, 0, None, 1.0)], "y int, x int, lat double, lon double")
    points = spark.createDataFrame([(0.0, 0.1, 3.0), (0.0, 0.9, 5.0)], "lat double, lon double, f double")
    assert {(r.y, r.x): r.f for r in grids.points_to_grid(points, cells, ["f"]).collect()} == {(0, 0): 3.0, (0, 1): 5.0, (1, 0): 4.0}
    masked = grids.station_mask(cells, spark.createDataFrame([("a", 0.0, 0.5), ("b", None, 0.5)], "station_id string, lat double, lon double"))
    assert {(r.y, r.x): r["mask"] for r in masked.select("y", "x", F.col("mask")).collect()} == {(0, 0): 1, (0, 1): 0, (1, 0): 0}
