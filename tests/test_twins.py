"""Queries without a SQL twin against plain numpy on the same tables."""

import duckdb
import numpy as np
import pytest

from heatloom.operators import sampling
from heatloom.plans import base, registry, stats

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("part", "orders", "lineitem", "supplier", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def features(con):
    return con.sql(f"WITH {base.STATIC} SELECT {', '.join(stats.FEATURES)} FROM static").df().astype(float)


def inflation(x):
    """1 / (1 - R²) of each column by least squares on the others."""
    out = []
    for j in range(x.shape[1]):
        others = np.column_stack([np.delete(x, j, 1), np.ones(len(x))])
        left = x[:, j] - others @ np.linalg.lstsq(others, x[:, j], rcond=None)[0]
        out.append(1 / (1 - min(1 - left.var() / x[:, j].var(), 0.999999)))
    return out


def test_vif(spark, features):
    got = {r.variable: r.vif for r in QUERIES["vif"](spark, SF).collect()}
    want = dict(zip(stats.FEATURES, inflation(((features - features.mean()) / features.std()).to_numpy()), strict=True))
    assert got == {k: pytest.approx(v, rel=1e-3) for k, v in want.items()}


def test_feature_drop_candidates(spark, features):
    r = features.corr()
    vifs = dict(zip(stats.FEATURES, inflation(((features - features.mean()) / features.std()).to_numpy()), strict=True))
    want = {(k, "vif") for k, v in vifs.items() if v >= 8} | {(k, "weak") for k in stats.FEATURES[1:] if abs(r.avg_height[k]) < 0.2}
    want |= {(b, "redundant") for a, b in (("building_density", "roughness"), ("avg_height", "roughness")) if abs(r[a][b]) >= 0.85}
    assert {tuple(x) for x in QUERIES["feature_drop_candidates"](spark, SF).collect()} == want and want


def test_laea_places_project_back(spark):
    """The forward projection of each place gives the eastings and northings that it came from."""
    pdf = QUERIES["laea_to_wgs84"](spark, SF).toPandas()
    e2 = (2 - 1 / 298.257222101) / 298.257222101
    e = np.sqrt(e2)
    q = lambda s: (1 - e2) * (s / (1 - e2 * s * s) + np.arctanh(e * s) / e)
    lat, lon, lat0 = np.radians(pdf.lat), np.radians(pdf.lon) - np.radians(10), np.radians(52)
    beta, beta0 = np.arcsin(q(np.sin(lat)) / q(1.0)), np.arcsin(q(np.sin(lat0)) / q(1.0))
    r = 6_378_137.0 * np.sqrt(q(1.0) / 2)
    d = 6_378_137.0 * np.cos(lat0) / np.sqrt(1 - e2 * np.sin(lat0) ** 2) / (r * np.cos(beta0))
    b = r * np.sqrt(2 / (1 + np.sin(beta0) * np.sin(beta) + np.cos(beta0) * np.cos(beta) * np.cos(lon)))
    x = 4_321_000 + b * d * np.cos(beta) * np.sin(lon)
    y = 3_210_000 + b / d * (np.cos(beta0) * np.sin(beta) - np.sin(beta0) * np.cos(beta) * np.cos(lon))
    assert np.allclose(x, 3_600_000 + pdf.k * 1000.0, atol=0.01) and np.allclose(y, 2_000_000 + pdf.k * 500.0, atol=0.01)


def test_perturb(spark, features):
    got = {(r.variable, r.epsilon_K): r for r in QUERIES["perturb"](spark, SF).collect()}
    assert set(got) == {(v, e) for v in stats.FEATURES[:2] for e in (0.1, 0.25, 0.5, 1.0)} and {r.n for r in got.values()} == {40 * len(features)}
    for (variable, e), r in got.items():
        assert r.spread == (pytest.approx(e, rel=0.04) if variable == "avg_height" else 0)


def test_sample_times(spark, con):
    """Each draw's number falls on the step that numpy's running sum says."""
    w = con.sql(f"WITH {stats.SERIES} SELECT time, value FROM s ORDER BY time").df()
    change = np.abs(np.diff(w.value, prepend=w.value[0]))
    w["weight"] = (change - change.min() + 1e-6) / (change - change.min() + 1e-6).sum()
    got = QUERIES["sample_times"](spark, SF).toPandas().sort_values("draw")
    u = sampling.draws(spark, len(w), 7).toPandas().sort_values("draw").u.to_numpy()
    at = np.minimum(np.searchsorted(np.cumsum(w.weight), u, side="right"), len(w) - 1)
    assert (got.draw.to_numpy() == np.arange(len(w))).all() and (got.time.to_numpy() == w.time.to_numpy()[at]).all()


def test_sample_tiles(spark, features):
    got = QUERIES["sample_tiles"](spark, SF).toPandas()
    assert len(got) == len(features) == got.draw.nunique()
    assert got.y0.between(0, 50 - 16).all() and got.x0.between(0, 40 - 16).all()
    size = [max(1, round(16 * m / k)) for m, k in ((5, 50), (4, 40))]
    for c, low, m, k, s in (("y0", "ly", 5, 50, size[0]), ("x0", "lx", 4, 40, size[1])):
        assert (got[low] == np.clip(np.round(got[c] * m / k), 0, m - s)).all()


def test_bootstrap_mean_ci(spark, con):
    """Ends lie about 1.96 standard errors from the mean; of 2,000 replicates, an end's own error is 0.06 of these."""
    raw = con.sql(f"WITH {base.RUNS} SELECT * FROM raw").df()
    got = QUERIES["bootstrap_mean_ci"](spark, SF).collect()
    assert len(got) == 3 * raw.model.nunique()
    ends = []
    for r in got:
        v = raw[raw.model == r.model][r.variable]
        se = v.std(ddof=0) / len(v) ** 0.5
        assert r.n == len(v) and r.mean == pytest.approx(v.mean())
        ends += [(r.mean - r.low) / se, (r.high - r.mean) / se]
    assert np.allclose(ends, 1.96, atol=0.3) and np.mean(ends) == pytest.approx(1.96, abs=0.06)


def test_ssim(spark, con):
    """Windows one by one, on frames that numpy enlarges itself."""
    e = con.sql("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id LIMIT 12").df()
    got = {r.vec_id: r.ssim for r in QUERIES["ssim"](spark, SF).collect()}
    at = np.clip((np.arange(16) + 0.5) / 2 - 0.5, 0, 7)
    lo, part = np.floor(at).astype(int), at - np.floor(at)
    hi = np.minimum(lo + 1, 7)
    g = np.exp(-0.5 * (np.arange(-5, 6) / 1.5) ** 2)
    w = np.outer(g, g) / g.sum() ** 2
    assert len(got) == con.sql("SELECT count(*) FROM embeddings").fetchall()[0][0]
    for vec_id, v in zip(e.vec_id, e.embedding, strict=True):
        f = np.array(v, float)[:64].reshape(8, 8)
        rows = f[lo] * (1 - part)[:, None] + f[hi] * part[:, None]
        a = rows[:, lo] * (1 - part) + rows[:, hi] * part
        b = f[np.arange(16) // 2][:, np.arange(16) // 2]
        span, each = b.max() - b.min(), []
        for y in range(6):
            for x in range(6):
                p, q = a[y : y + 11, x : x + 11], b[y : y + 11, x : x + 11]
                mp, mq = (w * p).sum(), (w * q).sum()
                vp, vq, cov = (w * (p - mp) ** 2).sum(), (w * (q - mq) ** 2).sum(), (w * (p - mp) * (q - mq)).sum()
                c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
                each.append((2 * mp * mq + c1) * (2 * cov + c2) / ((mp**2 + mq**2 + c1) * (vp + vq + c2)))
        assert got[vec_id] == pytest.approx(np.mean(each), abs=1e-6)
