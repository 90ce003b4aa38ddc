"""Data audits: missing values, coverage, gaps, overlap, and their verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heatloom.operators import ranges


def nan_budget(df: DataFrame, cols: list[str]) -> DataFrame:
    """variable, null_ratio (nulls and NaN), inf_ratio."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "variable", "value")
    return rows.groupBy("variable").agg(
        F.avg((F.col("value").isNull() | F.isnan("value")).cast("double")).alias("null_ratio"), F.avg(F.coalesce(F.abs("value") == float("inf"), F.lit(False)).cast("double")).alias("inf_ratio")
    )


def split_coverage(times: DataFrame, bounds: list[tuple[str, str, str]], good: float = 95, fair: float = 80) -> DataFrame:
    """split, present, expected (hours), pct, grade of each half-open bound."""
    spans = F.broadcast(times.sparkSession.createDataFrame(bounds, "split string, a string, b string").select("split", F.col("a").cast("timestamp").alias("a"), F.col("b").cast("timestamp").alias("b")))
    hours = times.select(F.date_trunc("hour", "time").alias("time")).distinct()
    held = spans.join(hours, (F.col("time") >= F.col("a")) & (F.col("time") < F.col("b")), "left").groupBy("split", "a", "b").agg(F.count("time").alias("present"))
    expected = ((F.unix_timestamp("b") - F.unix_timestamp("a")) / 3600).cast("bigint")
    out = held.select("split", "present", expected.alias("expected")).withColumn("pct", F.try_divide(100.0 * F.col("present"), F.col("expected")))
    return out.withColumn("grade", F.when(F.col("pct") >= good, "good").when(F.col("pct") >= fair, "fair").otherwise("poor"))


def bbox_overlap(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """One row, covered: the share of inner's bounding box (lat, lon) inside outer's; null for a box without area."""
    box = lambda df, p: df.agg(*[f(c).alias(f"{p}_{c}_{n}") for c in ("lat", "lon") for n, f in (("a", F.min), ("b", F.max))])
    side = lambda c: F.greatest(F.least(f"i_{c}_b", f"o_{c}_b") - F.greatest(f"i_{c}_a", f"o_{c}_a"), F.lit(0.0))
    area = (F.col("i_lat_b") - F.col("i_lat_a")) * (F.col("i_lon_b") - F.col("i_lon_a"))
    return box(inner, "i").crossJoin(box(outer, "o")).select(F.when(area > 0, side("lat") * side("lon") / area).alias("covered"))


def time_gaps(df: DataFrame, by: list[str] = (), step_h: float = 1.0) -> DataFrame:
    """by, gap_from, gap_to, hours of steps between distinct times over step_h."""
    times = df.select(*by, "time").distinct()
    rows = times.withColumn("gap_from", F.lag("time").over(Window.partitionBy(*by).orderBy("time"))).withColumn("hours", (F.unix_timestamp("time") - F.unix_timestamp("gap_from")) / 3600.0)
    return rows.where(F.col("hours") > step_h).select(*by, "gap_from", F.col("time").alias("gap_to"), "hours")


def step_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """by, n_gaps (steps over an hour), median_step_h."""
    rows = df.select(*by, "time").distinct().withColumn("h", (F.unix_timestamp("time") - F.unix_timestamp(F.lag("time").over(Window.partitionBy(*by).orderBy("time")))) / 3600.0)
    return rows.groupBy(*by).agg(F.count(F.when(F.col("h") > 1, 1)).alias("n_gaps"), F.percentile("h", 0.5).alias("median_step_h"))


def largest_gaps(gaps: DataFrame, k: int = 20) -> DataFrame:
    keys = [c for c in gaps.columns if c != "hours"]
    return gaps.orderBy(F.desc("hours"), *keys).limit(k)


def even_sample(times: DataFrame, n: int = 50) -> DataFrame:
    """time of n rows evenly spaced over the distinct times (all, if fewer)."""
    t = times.select("time").distinct()
    numbered = ranges.row_numbers(t, ["time"], "at")
    total = t.agg(F.count("*").alias("total"))
    wanted = times.sparkSession.range(n).crossJoin(total).select(F.when(F.col("total") <= n, F.col("id")).otherwise(F.floor(F.col("id") * (F.col("total") - 1) / max(1, n - 1))).alias("at")).distinct()
    return numbered.join(F.broadcast(wanted), "at").select("time")  # n rows


def coupling_report(rules: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """One row: issues, warnings, verdict. rules: (name, issue or warning, a table whose column `bad` says whether the rule is broken)."""
    rows = [df.agg(F.coalesce(F.bool_or("bad"), F.lit(False)).alias("bad")).select(F.lit(name).alias("rule"), F.lit(kind).alias("kind"), "bad") for name, kind, df in rules]
    broken = reduce(DataFrame.union, rows)
    n = lambda kind: F.count(F.when(F.col("bad") & (F.col("kind") == kind), 1))
    return broken.agg(n("issue").alias("issues"), n("warning").alias("warnings"), F.when(n("issue") > 0, "FAIL").otherwise("PASS").alias("verdict"))
