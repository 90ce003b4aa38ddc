"""Further forms of operators on hand-made rows: periods, two models, fine fields, draws and areas in batches."""

import math
from collections import defaultdict
from datetime import datetime
from decimal import ROUND_HALF_UP, Decimal

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from heatloom.functions import columns as C
from heatloom.operators import clean, grids, stats, urban, verify
from heatloom.plans import registry


def test_last_step_of_the_training_period(spark):
    df = spark.createDataFrame([(datetime(2020, 1, d), float(d)) for d in (1, 2, 3, 4)], "time timestamp, v double")
    mean = lambda **k: stats.norm_stats(df, ["v"], **k).first().mean
    assert (mean(), mean(period=("2020-01-01", "2020-01-03")), mean(period=("2020-01-01", "2020-01-03"), inclusive_end=False)) == (2.5, 2.0, 1.5)
    assert clean.filter_period(df, "2020-01-01", "2020-01-03").count() == 2


def test_months_of_years_and_months(spark):
    have = spark.createDataFrame([("201702",), ("201802",)], "month string")
    months = lambda a, b: sorted(r.month for r in clean.missing_months(have, a, b).collect())
    assert months("201701", "201703") == ["201701", "201703"] and months("2017", "2017") == ["201701"]
    assert len(months("2017", "2018")) == 12 and months("2017-02-05", "2017-03-01") == ["201703"] and months("2018", "2017") == []


def test_two_models_in_one_frame(spark):
    rows = [(datetime(2020, 1, 1, 14), 1.0, 3.0, 2.0), (datetime(2020, 1, 1, 14), 5.0, 2.0, 2.0), (datetime(2020, 1, 1, 14), float("nan"), 2.0, 2.0)]
    r = verify.frame_metrics_pair(spark.createDataFrame(rows, "time timestamp, pred_a double, pred_b double, t_c double")).first()
    assert (r.hour, r.mae_model_a, r.pred_a_mean, r.hr_mean) == (14, 2.0, 3.0, 2.0) and math.isclose(r.rmse_model_a, 5**0.5) and math.isclose(r.mae_model_b, 1 / 3)


def test_means_of_two_models_are_exact_in_any_order(spark):
    """Means are correctly rounded, as math.fsum gives them; 2 ** 40 takes the way of large values."""
    rng = np.random.default_rng(5)
    rows = [(datetime(2020, 1, 1), *(float(v) for v in rng.normal(20, 8, 3))) for _ in range(3_000)]
    for order in (rows, rows[::-1]):
        r = verify.frame_metrics_pair(spark.createDataFrame(order, "time timestamp, pred_a double, pred_b double, t_c double").repartition(7)).first()
        mean = lambda f: math.fsum(f(x) for x in rows) / len(rows)
        assert (r.pred_a_mean, r.pred_b_mean, r.hr_mean) == (mean(lambda x: x[1]), mean(lambda x: x[2]), mean(lambda x: x[3]))
        assert (r.mae_model_a, r.rmse_model_b) == (mean(lambda x: abs(x[1] - x[3])), mean(lambda x: (x[2] - x[3]) * (x[2] - x[3])) ** 0.5)
    far = spark.createDataFrame([(1.0, None, float("nan")), (2.0**40, None, 1.0), (-0.5, None, 1.0)], "a double, b double, c double")
    got = far.agg(*[C.exact_mean(F.col(c)).alias(c) for c in "abc"]).first()
    assert got.a == (2.0**40 + 0.5) / 3 and got.b is None and math.isnan(got.c)


def test_two_models_round_their_exact_means(spark):
    """All frames of sf0.01: 15 of their means lie half-way between two rounded numbers, but for the error of single rows' products, which sums in any order lose."""
    sf = "/root/testdata/sf0.01"
    cells, frames = defaultdict(list), defaultdict(list)
    for week, k, q, tax, less in duckdb.sql(f"SELECT date_trunc('week', l_shipdate), l_suppkey, l_quantity, l_tax, l_discount FROM '{sf}/lineitem.parquet'").fetchall():
        cells[week, k].append((q, q * (1 + tax - less)))
    mean = lambda v: math.fsum(v) / len(v)
    for (week, k), v in cells.items():
        a, r = (mean(x) for x in zip(*v, strict=True))
        frames[week].append((a, a * 0.9 + k % 10, r))
    got = {r.time.replace(tzinfo=None): r for r in registry.queries()["frame_metrics_pair"](spark, sf).collect()}
    rounded = lambda v: float(Decimal(repr(v)).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    for week, v in frames.items():
        a, b, ref = zip(*v, strict=True)
        want = (mean(a), mean(b), mean(ref), mean([abs(x - y) for x, y in zip(a, ref, strict=True)]), mean([abs(x - y) for x, y in zip(b, ref, strict=True)]))
        r = got.pop(week)
        assert (r.pred_a_mean, r.pred_b_mean, r.hr_mean, r.mae_model_a, r.mae_model_b) == tuple(map(rounded, want))
    assert not got


def test_fine_field_has_no_time_pass(spark):
    rows = [("a", 0, 0, None), ("a", 0, 1, None), ("b", 0, 0, 4.0), ("b", 0, 1, None)]
    df = spark.createDataFrame(rows, "time string, y int, x int, v double")
    got = {(r.time, r.x): r.v for r in grids.fill_grid(df, "v", [], ("x", "y")).collect()}
    assert got == {("a", 0): 4.0, ("a", 1): 4.0, ("b", 0): 4.0, ("b", 1): 4.0}
    assert [r.v for r in grids.fill_grid(df.where("time = 'a'"), "v", [], ("x", "y")).collect()] == [0.0, 0.0]


def test_residual_map_of_constants(spark):
    fine = spark.range(32).select((F.col("id") % 2).cast("string").alias("time"), F.floor(F.col("id") / 8).cast("int").alias("y"), (F.floor(F.col("id") / 2) % 4).cast("int").alias("x"), F.lit(7.0).alias("v"))
    coarse = spark.createDataFrame([(y, x, v) for y in (0, 1) for x in (0, 1) for v in (4.0, 6.0, None)], "gy int, gx int, v double")
    assert {r.value for r in grids.residual_map(fine, coarse, (2, 2), (4, 4), "v").collect()} == {2.0}


@pytest.mark.parametrize("turned", ["as_is", "rot90", "rot180", "rot270", "flip_y", "flip_x", "transpose"])
def test_orientation_is_found(spark, turned):
    a = np.random.default_rng(1).random((5, 5))
    b = {"as_is": a, "rot90": np.rot90(a), "rot180": np.rot90(a, 2), "rot270": np.rot90(a, 3), "flip_y": np.flipud(a), "flip_x": np.fliplr(a), "transpose": a.T}[turned]
    rows = lambda f: spark.createDataFrame([(y, x, float(f[y, x])) for y in range(5) for x in range(5)], "y int, x int, value double")
    got = {r.variant: r for r in grids.orientation_score(rows(a), rows(b), 5).collect()}
    assert [k for k, r in got.items() if r.is_best] == [turned] and math.isclose(got[turned].r, 1.0)
    assert len(got) == 9 and math.isclose(got["rot90"].r, got["transpose_flip_y"].r) and math.isclose(got["rot270"].r, got["transpose_flip_x"].r)


def test_weak_inputs_skip_unknown_ones(spark):
    corr = spark.createDataFrame([("a", 0.09), ("b", -0.1), ("c", None), ("d", -0.01), ("e", float("nan"))], "variable string, r double")
    assert {r.variable for r in stats.weak_inputs(corr).collect()} == {"a", "d"}


@pytest.mark.parametrize("mean", [1, 3, 50, 100_000])
def test_poisson_draws(mean):
    hashes = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 200)
    drawn = stats.poisson_draws(np.full(200, mean), hashes, 500)
    assert (drawn >= 0).all() and (drawn == np.floor(drawn)).all()
    assert abs(drawn.mean() - mean) < 5 * (mean / drawn.size) ** 0.5 and abs(drawn.var() / mean - 1) < 0.03
    assert (stats.poisson_draws(np.array([mean, 2]), hashes[:2], 500)[0] == drawn[0]).all()
    if mean == 1:
        assert abs((drawn == 0).mean() - math.exp(-1)) < 0.01
    pairs = np.corrcoef(drawn[:20])
    assert np.abs(pairs[np.triu_indices(20, 1)]).max() < 0.25


def test_bootstrap_by_batch_equals_by_hand(spark):
    rows = spark.createDataFrame([(g, float(v)) for g in ("a", "b", None) for v in (1, 1, 2, 5, 9)], "g string, value double")
    got = {(r.g, r.replicate): r["mean"] for r in stats.replicate_means(rows.repartition(3), ["g"], 40, 7).collect()}
    again = {(r.g, r.replicate): r["mean"] for r in stats.replicate_means(rows.coalesce(1), ["g"], 40, 7).collect()}
    assert got.keys() == again.keys() and all(math.isclose(got[k], again[k]) for k in got) and {k[0] for k in got} == {"a", "b", None}
    for g in ("a", "b", None):
        counts = rows.where(F.col("g").eqNullSafe(g)).groupBy("g", "value").count().withColumn("h", F.xxhash64("g", "value", F.lit(7))).toPandas()
        weight = stats.poisson_draws(counts["count"].to_numpy(), counts.h.to_numpy(), 40)
        for k in range(40):
            if weight[:, k].sum():
                assert math.isclose(got[g, k], (weight[:, k] * counts.value).sum() / weight[:, k].sum())


def test_areas_of_a_batch_against_a_fine_lattice():
    rng, xs, ys, want, r = np.random.default_rng(4), [], [], [], 1.0
    step = np.linspace(-1.2, 1.2, 1201)
    px, py = np.meshgrid(step, step)
    disc = px * px + py * py <= r * r
    for n in (3, 4, 7, 12):
        turn = np.sort(rng.random(n)) * 2 * math.pi
        x, y = 0.3 + 1.1 * rng.random() * np.cos(turn), -0.2 + 1.1 * rng.random() * np.sin(turn)
        inside = np.zeros(px.shape, bool)
        for a in range(n):
            b = (a + 1) % n
            crosses = (y[a] > py) != (y[b] > py)
            with np.errstate(divide="ignore", invalid="ignore"):
                inside ^= crosses & (px < (x[b] - x[a]) * (py - y[a]) / (y[b] - y[a]) + x[a])
        xs.append(x + 5), ys.append(y - 3), want.append((inside & disc).sum() * (step[1] - step[0]) ** 2)
    xs += [np.zeros(0), np.full(3, 5.0), np.array([-1e3, 1e3, 1e3, -1e3])]  # no corner, one spot, a square around the disc
    ys += [np.zeros(0), np.full(3, -3.0), np.array([-1e3, -1e3, 1e3, 1e3])]
    got = urban.disc_areas(xs, ys, np.full(len(xs), 5.0), np.full(len(xs), -3.0), r)
    assert np.allclose(got, [*want, 0, 0, math.pi], atol=4e-3)
    assert np.allclose(got, [urban.disc_polygon_area(np.stack([x, y], 1), (5.0, -3.0), r) for x, y in zip(xs, ys, strict=True)])
