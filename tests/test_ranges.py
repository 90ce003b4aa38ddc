"""Running sums, numbers and neighbours over ranges: as over one window, for any number of parts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from heatloom.operators import grids, ranges, sampling


@pytest.fixture(params=[1, 3, 16])
def parts(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def rows(n=200):
    rnd = random.Random(2)
    out = [(k // 7, k % 7, rnd.random(), rnd.choice([None, rnd.random()])) for k in range(n)]
    rnd.shuffle(out)
    return out


def test_as_one_window(spark, parts):
    data = rows()
    df = spark.createDataFrame(data, "a int, b int, weight double, v double")
    want, total = {}, 0.0
    previous = None
    for n, (a, b, w, v) in enumerate(sorted(data, key=lambda r: r[:2])):
        want[a, b] = (n, total, total + w, previous)
        total, previous = total + w, v
    sums = {(r.a, r.b): (r["__before"], r["__upto"]) for r in ranges.running_sum(df, "weight", ["a", "b"]).collect()}
    numbers = {(r.a, r.b): r.at for r in ranges.row_numbers(df, ["a", "b"], "at").collect()}
    lags = {(r.a, r.b): r.p for r in ranges.with_previous(df, "v", ["a", "b"], "p").collect()}
    assert all(numbers[k] == n and lags[k] == p and sums[k] == pytest.approx((low, high)) for k, (n, low, high, p) in want.items())
    ordered = [sums[k] for k in sorted(sums)]
    assert all(x[1] == y[0] for x, y in zip(ordered, ordered[1:], strict=False))  # to the last bit: no draw falls between two rows
    assert ranges.running_sum(df.limit(0), "weight", ["a"]).count() == 0


def test_no_draw_is_lost(spark, parts):
    df = spark.createDataFrame(rows(), "a int, b int, weight double, v double")
    total = df.agg(F.sum("weight")).first()[0]
    cdf = sampling.weights_cdf(df.withColumn("weight", F.col("weight") / total), ["a", "b"])
    assert sampling.sample_times(cdf, 3_000, 5).count() == 3_000


def test_next_over_ranges(spark, parts):
    t0, rnd = dt.datetime(2024, 1, 1), random.Random(5)
    times = sorted(t0 + dt.timedelta(hours=rnd.randrange(3000)) for _ in range(40))
    asked = [t0 + dt.timedelta(hours=rnd.randrange(3300)) for _ in range(100)] + times[:5]
    got = grids.asof_next(spark.createDataFrame([(t,) for t in times], "time timestamp"), spark.createDataFrame([(t,) for t in asked], "req timestamp"))
    assert sorted((r.req, r.time) for r in got.collect()) == sorted((q, next((t for t in times if t >= q), times[-1])) for q in asked)


def test_no_window_takes_all_rows_to_one_task(spark):
    """The only exchanges to one partition are those of the table with a row a part, and of totals."""
    df = spark.createDataFrame(rows(), "a int, b int, weight double, v double")
    plan = ranges.running_sum(df, "weight", ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    for part in plan.split("Exchange SinglePartition")[1:]:
        assert "HashAggregate" in part.split("Scan")[0] or "SortAggregate" in part.split("Scan")[0]
