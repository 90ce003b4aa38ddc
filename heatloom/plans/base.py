"""Registration of queries, and the driver's tables read as stations, grids and metric rows, in Spark and in SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, rounded: str = "", digits: int = 6):
    """Registers a query, and its SQL twin; the columns in `rounded` are rounded on both sides, since engines sum in different orders."""
    columns = rounded.split()

    def add(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.round(c, digits) for c in columns}) if columns else df

        QUERIES[f.__name__] = run
        if sql:
            replaced = ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in columns)
            SQL[f.__name__] = f"SELECT * REPLACE ({replaced}) FROM ({sql})" if columns else sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OBS = """obs AS (SELECT ts AS time, CAST(user_id AS VARCHAR) AS station_id, 41.2::DOUBLE + (user_id % 40) / 100.0::DOUBLE AS lat, 2.0::DOUBLE + (user_id % 30) / 100.0::DOUBLE AS lon, value AS obs_c, event_type AS model FROM events)"""
HOURLY = OBS + """, hourly AS (SELECT date_trunc('hour', time) AS time, station_id, avg(obs_c) AS obs_c, count(obs_c) AS n_obs_raw FROM obs GROUP BY 1, 2)"""
TMAX = HOURLY + """, tmax AS (SELECT station_id, CAST(time AS DATE) AS day, max(obs_c) AS tmax FROM hourly GROUP BY 1, 2)"""
THR = TMAX + """, thr AS (SELECT station_id, quantile_cont(tmax, 0.95) AS thr FROM tmax GROUP BY 1)"""
GRID = """grid AS (SELECT date_trunc('week', l_shipdate) AS time, CAST(l_suppkey // 10 AS INT) AS y, CAST(l_suppkey % 10 AS INT) AS x, avg(l_quantity) AS pred_c, avg(l_quantity * (1 + l_tax - l_discount)) AS t_c FROM lineitem GROUP BY 1, 2, 3)"""
CELLS = """cells AS (SELECT CAST(s_suppkey // 10 AS INT) AS y, CAST(s_suppkey % 10 AS INT) AS x, 41.2::DOUBLE + (s_suppkey // 10) * 0.01::DOUBLE AS lat, 2.0::DOUBLE + (s_suppkey % 10) * 0.03::DOUBLE AS lon, s_acctbal AS value FROM supplier)"""
RUNS = """raw AS (SELECT o_orderpriority AS model, o_orderstatus AS variant, o_orderdate + to_hours(o_orderkey % 24) AS time, o_totalprice / 1000 AS mae, o_totalprice / 800 + o_orderkey % 7 AS rmse, 1 - o_totalprice / 1000000 AS ssim,
CASE WHEN o_orderkey % 3 = 0 THEN 'run' ELSE 'run_S' || (o_custkey % 5) || '_a' END AS experiment FROM orders)"""
STATIC = """static AS (SELECT CAST(p_partkey // 40 AS INT) AS y, CAST(p_partkey % 40 AS INT) AS x, p_retailprice AS avg_height, p_size / 50.0 AS building_density, (p_partkey * 7 % 100) / 100.0 AS ndvi_mean, (p_partkey * 13 % 101) / 101.0 AS svf, p_size * p_retailprice / 10000 AS roughness, p_brand AS brand, p_partkey FROM part)"""


def obs(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("user_id")
    return table(spark, d, "events").select(
        F.col("ts").cast("timestamp").alias("time"), u.cast("string").alias("station_id"), (41.2 + (u % 40) / 100.0).alias("lat"), (2.0 + (u % 30) / 100.0).alias("lon"), F.col("value").alias("obs_c"), F.col("event_type").alias("model")
    )


def grid(spark: SparkSession, d: str, mean: Callable[[Column], Column] = F.avg) -> DataFrame:
    k = F.col("l_suppkey")
    cell = [F.floor(k / 10).cast("int").alias("y"), (k % 10).cast("int").alias("x")]
    return table(spark, d, "lineitem").groupBy(F.date_trunc("week", F.col("l_shipdate").cast("timestamp")).alias("time"), *cell).agg(mean(F.col("l_quantity")).alias("pred_c"), mean(F.col("l_quantity") * (1 + F.col("l_tax") - F.col("l_discount"))).alias("t_c"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    y, x = F.floor(k / 10).cast("int"), (k % 10).cast("int")
    return table(spark, d, "supplier").select(y.alias("y"), x.alias("x"), (41.2 + y * 0.01).alias("lat"), (2.0 + x * 0.03).alias("lon"), F.col("s_acctbal").alias("value"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("variant"), (F.col("o_orderdate").cast("timestamp") + F.make_interval(hours=(k % 24).cast("int"))).alias("time"), (price / 1000).alias("mae"),
        (price / 800 + k % 7).alias("rmse"), (1 - price / 1000000).alias("ssim"), F.when(k % 3 == 0, "run").otherwise(F.concat(F.lit("run_S"), (F.col("o_custkey") % 5).cast("string"), F.lit("_a"))).alias("experiment"),
    )


def static(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        F.floor(k / 40).cast("int").alias("y"), (k % 40).cast("int").alias("x"), F.col("p_retailprice").alias("avg_height"), (F.col("p_size") / 50.0).alias("building_density"), (k * 7 % 100 / 100.0).alias("ndvi_mean"),
        (k * 13 % 101 / 101.0).alias("svf"), (F.col("p_size") * F.col("p_retailprice") / 10000).alias("roughness"), F.col("p_brand").alias("brand"), k,
    )
