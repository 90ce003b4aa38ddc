"""Linear interpolation of scattered points against a brute triangulation."""

import itertools

import numpy as np
import pytest

from heatloom.operators import scattered


def brute(points, values, q):
    """The value in the triangle with an empty circle that holds q; of the nearest point outside."""
    triples = np.array(list(itertools.combinations(range(len(points)), 3)))
    a, b, c = (points[t] for t in triples.T)
    den = (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (c[:, 0] - a[:, 0]) * (b[:, 1] - a[:, 1])
    v = ((q[0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (c[:, 0] - a[:, 0]) * (q[1] - a[:, 1])) / den
    w = ((b[:, 0] - a[:, 0]) * (q[1] - a[:, 1]) - (q[0] - a[:, 0]) * (b[:, 1] - a[:, 1])) / den
    weights = np.stack([1 - v - w, v, w], axis=1)
    for n in np.flatnonzero((weights >= 0).all(1)):
        t = triples[n]
        plane = np.linalg.solve(np.column_stack([points[t], np.ones(3)]), (points[t] ** 2).sum(1))
        if ((points**2).sum(1) - points @ plane[:2] - plane[2] > -1e-9).all():
            return float(weights[n] @ values[t])
    return float(values[((points - q) ** 2).sum(1).argmin()])


def frames(spark, points, values, cells):
    p = spark.createDataFrame([(float(y), float(x), float(v)) for (x, y), v in zip(points, values, strict=True)], "lat double, lon double, v double")
    c = spark.createDataFrame([(n, 0, float(y), float(x)) for n, (x, y) in enumerate(cells)], "y int, x int, lat double, lon double")
    return p, c


@pytest.mark.parametrize("per_tile", [4, 64, 10_000])
def test_equals_a_brute_triangulation(spark, per_tile):
    """Dense and empty parts, targets inside and outside; the size of tiles changes nothing."""
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.random((40, 2)), 0.2 + 0.05 * rng.random((25, 2)), [[3.0, 0.5]]])
    values = rng.random(len(points))
    cells = np.concatenate([rng.random((60, 2)) * [1.4, 1.2] - 0.1, 0.2 + 0.05 * rng.random((20, 2)), points[:4], [[2.0, 0.5], [9.0, 9.0]]])
    got = {r.y: r.v for r in scattered.interpolate_linear(*frames(spark, points, values, cells), ["v"], per_tile).collect()}
    want = [brute(points, values, q) for q in cells]
    assert len(got) == len(cells) and max(abs(got[n] - v) for n, v in enumerate(want)) < 1e-5


def test_many_points_in_tiles(spark):
    """500 points: tiles of any size give the same, and a plane is met exactly; a lattice with all its ties, too."""
    rng = np.random.default_rng(6)
    points, cells = rng.random((500, 2)), rng.random((300, 2))
    a, b = ({r.y: r.v for r in scattered.interpolate_linear(*frames(spark, points, np.sin(9 * points).sum(1), cells), ["v"], k).collect()} for k in (3, 500))
    assert max(abs(a[n] - b[n]) for n in a) < 1e-7
    lattice = np.array([[x / 4, y / 4] for x in range(12) for y in range(12)])
    plane = lambda p: 3 * p[:, 0] - 2 * p[:, 1] + 7
    inside = np.concatenate([rng.random((50, 2)) * 2.75, lattice[::5]])
    got = {r.y: r.v for r in scattered.interpolate_linear(*frames(spark, lattice, plane(lattice), inside), ["v"], 6).collect()}
    assert max(abs(got[n] - v) for n, v in enumerate(plane(inside))) < 1e-6


def test_odd_tables(spark):
    line = np.array([[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]])
    run = lambda p, v, c: {r.y: r.v for r in scattered.interpolate_linear(*frames(spark, np.array(p), v, np.array(c)), ["v"]).collect()}
    assert run(line, [1, 2, 3], [[0.1, 0.2], [5.0, 5.0]]) == {0: 1.0, 1: 3.0}  # no triangle
    assert run([[1.0, 1.0]], [4], [[0.0, 0.0]]) == {0: 4.0}
    assert run([[1.0, 1.0], [1.0, 1.0]], [4, 6], [[0.0, 0.0], [np.nan, 1.0]]) == {0: 5.0, 1: 5.0}
    square = [[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [1.0, 1.1]]
    got = run(square, [1, 2, 3, np.nan], [[0.2, 0.2], [0.9, 0.9], [0.7, 0.4]])
    assert got[0] == pytest.approx(1 + 0.2 + 0.4) and got[1] == pytest.approx((got[0] + got[2]) / 2) and got[2] == 2.0  # the nearest point has no value; neither has a corner
    p, c = frames(spark, square, [1, 2, 3, 4], [[0.2, 0.2]])
    assert scattered.interpolate_linear(p.limit(0), c, ["v"]).first().v is None
    assert scattered.interpolate_linear(p, c.limit(0), ["v"]).count() == 0
