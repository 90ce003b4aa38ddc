"""Percentiles by counts in bins against numpy's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heatloom.operators import selection, stats

PARTS = [0.0, 0.02, 0.5, 0.95, 1.0]


@pytest.mark.parametrize("kind", ["even", "outliers", "ties", "tiny steps", "huge"])
@pytest.mark.parametrize("bins,few", [(4, 3), (64, 0), (4_096, 20_000)])
def test_percentiles_equal_numpy(spark, kind, bins, few):
    rng = np.random.default_rng(5)
    v = {
        "even": rng.random(400), "outliers": np.concatenate([rng.normal(0, 1e-9, 399), [1e200]]), "ties": np.repeat([1.0, 2.0, 2.0, 9.0], 100),
        "tiny steps": 1 + np.arange(300) * 2.0**-52, "huge": np.array([-1.7e308, -1.0, 0.0, 1.0, 1.7e308] * 20),
    }[kind]
    df = spark.createDataFrame([(float(x),) for x in rng.permutation(v)], "v double")
    got = selection.percentiles(df, {"v": F.col("v")}, PARTS, bins, few)["v"]
    want = [df.agg(F.percentile("v", p)).first()[0] for p in PARTS]
    assert got == {"min": v.min(), "max": v.max(), "at": want}


def test_percentiles_of_odd_columns(spark):
    df = spark.createDataFrame([(1.0, None, 5), (float("nan"), None, 5), (float("inf"), None, 5), (3.0, None, None)], "a double, b double, c int")
    got = selection.percentiles(df, {c: F.col(c) for c in "abc"}, [0.5])
    assert [got[c]["at"] for c in "abc"] == [[2.0], [None], [5.0]] and got["b"]["min"] is None
    assert selection.percentiles(df.where("false"), {"a": F.col("a")}, [0.5])["a"]["at"] == [None]
    scaled = stats.robust_scale(df.where("a > 0"), ["a", "b", "c"], 0.0, 1.0).collect()
    assert all(r.b == 0.0 and r.c == 0.0 for r in scaled) and sorted(r.a for r in scaled if r.a is not None) == [0.0, 1.0]
