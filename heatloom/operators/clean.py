"""Filters, labels and set operations that prepare readings, grids and metric rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heatloom.functions import columns as C


def kelvin_guard(df: DataFrame, col: str) -> DataFrame:
    """Celsius: if the mean of the whole column is over 200, 273.15 is subtracted. The mean is one broadcast row."""
    mean = F.broadcast(df.agg(F.avg(col).alias("__mean")))
    return df.crossJoin(mean).withColumn(col, F.when(F.col("__mean") > 200, F.col(col) - 273.15).otherwise(F.col(col))).drop("__mean")


def coerce_numeric(df: DataFrame, cols: list[str], keys: list[str] = ()) -> DataFrame:
    """Text that is no number, NaN and infinities become null; rows with a null in cols or keys go."""
    return df.withColumns({c: C.finite(F.col(c).try_cast("double")) for c in cols}).na.drop(subset=[*cols, *keys])


def label_split(df: DataFrame, bounds: list[tuple[str, str, str]], time: str = "time") -> DataFrame:
    """split: the name of the half-open bound [start, end) that holds the time; null outside all."""
    out = F.lit(None).cast("string")
    for name, start, end in reversed(bounds):
        out = F.when((F.col(time) >= F.lit(start).cast("timestamp")) & (F.col(time) < F.lit(end).cast("timestamp")), name).otherwise(out)
    return df.withColumn("split", out)


def label_split_fraction(df: DataFrame, train: float, val: float, time: str = "time") -> DataFrame:
    """split by the place of a row's time among the distinct times: floor(n * train) first, then floor(n * val), the rest is test."""
    times = df.select(time).distinct()
    order = Window.orderBy(time)  # a row for each time step
    n = F.count("*").over(Window.partitionBy())
    at = F.row_number().over(order) - 1
    name = F.when(at < F.floor(n * train), "train").when(at < F.floor(n * train) + F.floor(n * val), "val").otherwise("test")
    return df.join(times.select(time, name.alias("split")), time)


def filter_period(df: DataFrame, start: str, end: str, months: list[int] | None = None, time: str = "time", inclusive_end: bool = False) -> DataFrame:
    t, last = F.col(time), F.lit(end).cast("timestamp")
    held = (t >= F.lit(start).cast("timestamp")) & (t <= last if inclusive_end else t < last)
    return df.where(held & F.month(t).isin(months) if months else held)


def clip_bbox(lr: DataFrame, hr: DataFrame, buffer: float = 0.15) -> DataFrame:
    """Rows of lr (lat, lon) inside the bounding box of hr, wider by buffer on each side."""
    box = F.broadcast(hr.agg(F.min("lat").alias("__a"), F.max("lat").alias("__b"), F.min("lon").alias("__c"), F.max("lon").alias("__d")))
    inside = F.col("lat").between(F.col("__a") - buffer, F.col("__b") + buffer) & F.col("lon").between(F.col("__c") - buffer, F.col("__d") + buffer)
    return lr.crossJoin(box).where(inside).drop("__a", "__b", "__c", "__d")


def filter_municipality(stations: DataFrame, names: list[str], operational_only: bool = False) -> DataFrame:
    """Stations in one of the municipalities, names compared without accents and case."""
    wanted = stations.sparkSession.createDataFrame([(n,) for n in names], "__name string").select(C.norm_text(F.col("__name")).alias("__name")).distinct()
    out = stations.withColumn("__name", C.norm_text(F.col("nom_municipi"))).join(F.broadcast(wanted), "__name", "left_semi").drop("__name")
    return out.where(F.col("nom_estat_ema") == "Operativa") if operational_only else out


def finite_metrics(df: DataFrame, cols: list[str] = ("mae", "rmse")) -> DataFrame:
    """Rows whose metrics are all finite numbers."""
    for c in cols:
        df = df.where(C.finite(F.col(c)).isNotNull())
    return df


def explode_segments(df: DataFrame, heat_hours: DataFrame | None = None, day: tuple[int, int] = (8, 19), offset_h: int = 0, time: str = "time") -> DataFrame:
    """A row for each segment of a time: all, day or night and, with heat_hours (time), heatwave or not, alone and with day or night."""
    local = F.col(time) + F.make_interval(hours=F.lit(offset_h))
    part = F.when(C.hour_in_window(local, *day), "day").otherwise("night")
    labels = [F.lit("all"), part]
    if heat_hours is not None:
        hot = F.broadcast(heat_hours.select(F.col(time).alias("__t")).distinct().withColumn("__hot", F.lit(True)))
        df = df.join(hot, F.col(time) == F.col("__t"), "left").drop("__t")
        kind = F.when(F.col("__hot"), "heatwave").otherwise("non_heatwave")
        labels += [kind, F.concat(part, F.lit("_"), kind)]
    return df.withColumn("segment", F.explode(F.array(*labels))).drop("__hot")


def neutral_fill(df: DataFrame, stats: DataFrame, cols: list[str]) -> DataFrame:
    """Columns that a source lacks, or nulls in them, take the training mean of stats (variable, mean)."""
    means = F.broadcast(stats.where(F.col("variable").isin(cols)).groupBy().pivot("variable", cols).agg(F.first("mean")).select(*[F.col(c).alias(f"__{c}") for c in cols]))
    own = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("double")
    return df.crossJoin(means).withColumns({c: F.coalesce(own(c), F.col(f"__{c}")) for c in cols}).drop(*[f"__{c}" for c in cols])


def select_features(df: DataFrame, schema: list[str], strict: bool = True, keys: list[str] = ("y", "x")) -> DataFrame:
    """keys and the features in order; a missing one is an error, or 0.0 if not strict."""
    missing = [c for c in schema if c not in df.columns]
    if missing and strict:
        raise ValueError(f"features missing: {missing}")
    return df.select(*keys, *[F.col(c).cast("double").alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in schema])


def valid_time(df: DataFrame, variables: list[str]) -> DataFrame:
    """Forecast rows (time, step in hours) by valid time time + step; rows without any value go; of a valid time's rows of a cell the first run stays."""
    keys = [c for c in df.columns if c not in {*variables, "time", "step"}]
    rows = df.na.drop("all", subset=variables).withColumn("valid_time", F.col("time") + F.make_interval(hours=F.col("step")))
    first = Window.partitionBy("valid_time", *keys).orderBy("time", "step")
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "time", "step").withColumnRenamed("valid_time", "time")


def detect_order(axis: DataFrame, by: list[str]) -> DataFrame:
    """by, axis_order: asc, desc or unknown for axis (index, value) of each grid."""
    step = F.col("value") - F.lag("value").over(Window.partitionBy(*by).orderBy("index"))
    steps = axis.withColumn("__d", step).groupBy(*by).agg(F.bool_and(F.col("__d") > 0).alias("__up"), F.bool_and(F.col("__d") < 0).alias("__down"))
    return steps.select(*by, F.when(F.col("__up"), "asc").when(F.col("__down"), "desc").otherwise("unknown").alias("axis_order"))


def flip_axis(df: DataFrame, index: str) -> DataFrame:
    """The same cells with the index counted from the other end."""
    last = F.broadcast(df.agg(F.max(index).alias("__last")))
    return df.crossJoin(last).withColumn(index, F.col("__last") - F.col(index)).drop("__last")


def validate_range(df: DataFrame, by: list[str], low: float = -20, high: float = 60, jump: float = 15, nan_share: float = 0.01, expected: tuple[float, float] | None = None) -> DataFrame:
    """by, verdict of each stack of frames (y, x, time, value), in this order: rejected, fixed_nans, unusual_range, large_temporal_jump, outside_expected_range, ok."""
    v = C.finite(F.col("value"))
    before = F.lag(v).over(Window.partitionBy(*by, "y", "x").orderBy("time"))
    stats = df.withColumns({"__v": v, "__j": F.abs(v - before)}).groupBy(*by).agg(
        F.avg(F.col("__v").isNull().cast("double")).alias("bad_share"), F.min("__v").alias("low"), F.max("__v").alias("high"), F.max("__j").alias("jump")
    )
    verdict = F.when(F.col("bad_share") >= nan_share, "rejected").when(F.col("bad_share") > 0, "fixed_nans")
    verdict = verdict.when((F.col("low") < low) | (F.col("high") > high), "unusual_range").when(F.col("jump") > jump, "large_temporal_jump")
    if expected:
        verdict = verdict.when((F.col("low") < expected[0] - 10) | (F.col("high") > expected[1] + 10), "outside_expected_range")
    return stats.withColumn("verdict", verdict.otherwise("ok"))


def union_runs(runs: dict[str, DataFrame], tag: str = "model") -> DataFrame:
    """The runs' rows in one table with the run's name; columns that a run lacks are null."""
    out = None
    for name, df in runs.items():
        tagged = df.withColumn(tag, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def feature_diff(requested: DataFrame, available: DataFrame) -> DataFrame:
    """feature, status: requested features that are available (selected) or not (missing)."""
    has = requested.intersect(available).withColumn("status", F.lit("selected"))
    return has.union(requested.subtract(available).withColumn("status", F.lit("missing")))


def day_of(bound: str) -> str:
    """The first day of a year (YYYY) or month (YYYYMM); a date stays as it is."""
    bound = str(bound)
    return bound if not bound.isdigit() else f"{bound[:4]}-{bound[4:6] or '01'}-01"


def missing_months(existing: DataFrame, start: str, end: str) -> DataFrame:
    """month (YYYYMM) from start to end, both included, that existing (month) lacks. Both are dates, months (YYYYMM) or years (YYYY), and a year means its January."""
    first, last = (F.date_trunc("month", F.lit(day_of(v)).cast("date")).cast("date") for v in (start, end))
    months = F.when(first <= last, F.sequence(first, last, F.expr("interval 1 month"))).otherwise(F.array().cast("array<date>"))
    wanted = existing.sparkSession.range(1).select(F.explode(months).alias("d"))
    return wanted.select(F.date_format("d", "yyyyMM").alias("month")).join(existing.select("month").distinct(), "month", "left_anti")


