"""Running sums, row numbers and neighbours in an order over all rows, without a window that takes them to one task.

Rows are dealt to parts by ranges of the order and written. Windows run inside parts; what a part has to know of those before or after it (a sum, a count,
a last value) is a row a part, added up in a table as long as the number of parts, and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatloom.sources import io


def parts_before() -> Window:
    """The parts before each one, in a table with a row a part."""
    return Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)


def parts_after() -> Window:
    return Window.orderBy("__p").rowsBetween(1, Window.unboundedFollowing)


def parts_by(df: DataFrame, order: list[str]) -> DataFrame:
    """df with __p, the number of its part: parts follow one another in the order, and equal keys share one."""
    spark, path = df.sparkSession, io.scratch(df.sparkSession, "ranges")
    df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()).write.parquet(path)
    return spark.read.schema(df.withColumn("__p", F.lit(0)).schema).parquet(path)


def inside(order: list) -> Window:
    return Window.partitionBy("__p").orderBy(*order)


def with_parts(rows: DataFrame, of_part: DataFrame) -> DataFrame:
    """rows with the columns of a table that has a row a part."""
    return rows.join(F.broadcast(of_part), "__p", "left")


def running_sum(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """df with __before and __upto: the sum of value over the rows before, and up to, each one. What one row's sum ends with the next one's begins with, to the last bit."""
    w = inside(order)
    own = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = parts_by(df, order).withColumn("__own", own).withColumn("__last", F.lead(F.lit(1)).over(w).isNull())
    before = rows.where("__last").groupBy("__p").agg(F.max("__own").alias("__t")).select("__p", F.coalesce(F.sum("__t").over(parts_before()), F.lit(0.0)).alias("__base"))
    both = with_parts(rows, before).withColumn("__before", F.col("__base") + F.coalesce(F.lag("__own").over(w), F.lit(0.0)))
    return both.withColumn("__upto", F.col("__base") + F.col("__own")).drop("__own", "__base", "__last", "__p")


def row_numbers(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with `out`: the number of each row from 0 on."""
    rows = parts_by(df, order)
    before = rows.groupBy("__p").agg(F.count("*").alias("__t")).select("__p", F.coalesce(F.sum("__t").over(parts_before()), F.lit(0)).alias("__base"))
    return with_parts(rows, before).withColumn(out, (F.col("__base") + F.row_number().over(inside(order)) - 1).cast("bigint")).drop("__base", "__p")


def with_previous(df: DataFrame, value: str, order: list[str], out: str) -> DataFrame:
    """df with `out`: the value of the row before, null for the first one."""
    rows, key = parts_by(df, order), F.struct(*order)
    ends = rows.groupBy("__p").agg(F.max_by(F.struct(value), key).alias("__e")).select("__p", F.lag("__e").over(Window.orderBy("__p")).alias("__ends"))
    w = inside(order)
    first = F.row_number().over(w) == 1
    return with_parts(rows, ends).withColumn(out, F.when(first, F.col("__ends").getField(value)).otherwise(F.lag(value).over(w))).drop("__ends", "__p")


def next_or_own(df: DataFrame, value: Column, order: list, by: list[str], out: str) -> DataFrame:
    """df with `out`: the first non-null value at the row or after it, in the order; values grow with it. by: the columns of the order that part rows by ranges."""
    rows = parts_by(df, by).withColumn("__x", value)
    later = rows.groupBy("__p").agg(F.min("__x").alias("__m")).select("__p", F.min("__m").over(parts_after()).alias("__later"))
    own = F.first("__x", True).over(inside(order).rowsBetween(0, Window.unboundedFollowing))
    return with_parts(rows, later).withColumn(out, F.coalesce(own, F.col("__later"))).drop("__x", "__later", "__p")
