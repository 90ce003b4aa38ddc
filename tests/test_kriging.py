"""Kriging over tiles against one task's plain arrays."""

import numpy as np
import pandas as pd
import pytest

from heatloom.operators import geostat, regions


def plain_estimate(xy, v, target, model, k=48):
    """One target at a time."""
    out = []
    for t in target:
        near = np.sort(np.argsort(((xy - t) ** 2).sum(1), kind="stable")[:k])
        p, m = xy[near], len(near)
        system = np.ones((m + 1, m + 1))
        system[:m, :m] = geostat.spherical(np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1)), *model)
        system[m, m] = 0
        right = np.append(geostat.spherical(np.sqrt(((p - t) ** 2).sum(1)), *model), 1.0)
        out.append(np.linalg.solve(system + np.eye(m + 1) * 1e-10, right)[:m] @ v[near])
    return np.array(out)


def plain_folds(df, k=48):
    """Each method's values by fold and id, on arrays of all points (id, x, y, value, cls, fold)."""
    out = {}
    fit = lambda xy, v, **how: geostat.fit_spherical(*geostat.empirical(xy, v, **how))
    for fold in sorted(df.fold.unique()):
        tr, te = df[df.fold != fold], df[df.fold == fold].sort_values("id")
        tr = tr.sort_values("id")
        xy, v, c = tr[["x", "y"]].to_numpy(), tr.value.to_numpy(), tr.cls.to_numpy()
        txy, tc, mean = te[["x", "y"]].to_numpy(), te.cls.to_numpy(), v.mean()
        base = fit(xy, v - mean)
        means = {a: v[c == a].mean() for a in np.unique(c)}
        left = v - np.array([means[a] for a in c])
        got = {"global": mean + plain_estimate(xy, v - mean, txy, base, k), "class_drift": np.array([means.get(a, mean) for a in tc]) + plain_estimate(xy, left, txy, fit(xy, left) or base, k)}
        moving, model = [], None
        for s in range(0, len(te), 200):
            near = np.sort(np.argsort(((xy - txy[s]) ** 2).sum(1), kind="stable")[:k])
            model = fit(xy[near], v[near] - mean, n_bins=8) or model
            moving.append(mean + plain_estimate(xy, v - mean, txy[s : s + 200], model, k))
        got["moving_window"], got["per_class"] = np.concatenate(moving), got["class_drift"].copy()
        for a in np.unique(tc):
            there = c == a
            own = fit(xy[there], v[there] - v[there].mean()) if there.sum() >= 60 else None
            if own:
                got["per_class"][tc == a] = v[there].mean() + plain_estimate(xy[there], v[there] - v[there].mean(), txy[tc == a], own, k)
        out |= {(int(fold), int(i), m): got[m][n] for n, i in enumerate(te.id) for m in geostat.METHODS}
    return out


def field(n, seed=4):
    rng = np.random.default_rng(seed)
    xy = np.concatenate([rng.uniform(0, 10, (n - n // 3, 2)), rng.normal(2, 0.2, (n // 3, 2))])
    cls = np.where(np.arange(n) < 12, 9, np.arange(n) % 3)  # class 9 has too few points for itself
    v = np.sin(xy[:, 0]) * 2 + np.cos(xy[:, 1]) + 0.5 * cls + rng.normal(0, 0.1, n)
    return pd.DataFrame({"id": np.arange(n), "x": xy[:, 0], "y": xy[:, 1], "value": v, "cls": cls})


def test_block_predictions_equal_one_task(spark):
    pdf = field(1_400)
    df = spark.createDataFrame(pdf)
    odd = spark.createDataFrame([(9_001, None, 1.0, 1.0, 1), (9_002, 1.0, float("nan"), 1.0, 1), (9_003, 1.0, 1.0, None, 1)], "id long, x double, y double, value double, cls long")
    got = geostat.block_predictions(df.union(odd).repartition(7)).toPandas()
    folds = geostat.block_folds(df).toPandas()
    want = plain_folds(folds)
    assert len(got) == 1_400 and set(got.fold) == {0, 1, 2, 3}
    at = {(int(r["fold"]), int(r["id"]), m): r[m] for _, r in got.iterrows() for m in geostat.METHODS}
    assert at.keys() == want.keys()
    keys = sorted(want)
    assert np.allclose([at[x] for x in keys], [want[x] for x in keys], rtol=1e-5, atol=1e-5)


def test_neighbours_of_tiles(spark):
    """Crowds, holes, repeated places and groups of few points: the neighbours are those of all points."""
    rng = np.random.default_rng(8)
    xy = np.concatenate([rng.uniform(0, 1, (700, 2)), rng.normal(0.3, 1e-4, (300, 2)), np.full((90, 2), 0.7), np.round(rng.uniform(0, 1, (200, 2)), 1)])
    xy = xy[(np.abs(xy - 0.5) > 0.2).any(1)]
    group = np.where(np.arange(len(xy)) % 300 == 5, "few", "many")
    points = pd.DataFrame({"g": group, "id": np.arange(len(xy)), "x": xy[:, 0], "y": xy[:, 1]})
    t = np.concatenate([rng.uniform(0.3, 0.7, (60, 2)), rng.uniform(-1, 2, (60, 2)), xy[:40]])
    targets = pd.concat([pd.DataFrame({"g": g, "id": np.arange(len(t)), "x": t[:, 0], "y": t[:, 1]}) for g in ("many", "few", "nobody")])

    def work(some, p, near):
        return pd.DataFrame({"id": some.id.to_numpy(), "found": list(p.id.to_numpy()[near])})

    got = regions.with_neighbours(spark.createDataFrame(targets), spark.createDataFrame(points).repartition(5), ["g"], 10, work, "id long, found array<long>").collect()
    assert {r.g for r in got} == {"many", "few"} and len(got) == 2 * len(t)
    for r in got:
        own = points[points.g == r.g]
        d2 = ((own[["x", "y"]].to_numpy() - t[r.id]) ** 2).sum(1)
        assert r.found == sorted(own.id.to_numpy()[np.argsort(d2, kind="stable")[:10]].tolist())
    nothing = spark.createDataFrame(points).where("false")
    assert regions.with_neighbours(nothing, nothing, ["g"], 10, work, "id long, found array<long>").count() == 0


def test_models_of_classes_are_those_of_each_alone(spark):
    df = spark.createDataFrame(field(900))
    got = {r.cls: r for r in geostat.fit_models(geostat.variogram(df, by=["cls"], sample=200), ["cls"]).collect()}
    for c in range(3):
        alone = geostat.variogram(df.where(f"cls = {c}"), sample=200).orderBy("bin").toPandas()
        model = geostat.fit_spherical(alone.lag.to_numpy(), alone.semivariance.to_numpy())
        assert (got[c].nugget, got[c].sill, got[c].range) == pytest.approx(model)
