"""Live alerts with Structured Streaming; each stream has the results of its batch twin, whatever the batches in which rows come, as long as none is older than the watermark."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from heatloom.functions import columns as C
from heatloom.operators import heat
from heatloom.streaming.day_store import DayStore
from heatloom.streaming.outbox import Outbox
from heatloom.streaming.state import HOUR, Anomalies, HeatEvents, InOrder

CHANNELS = {"watch": ["dashboard"], "warning": ["dashboard", "email"], "severe": ["dashboard", "email", "webhook"]}


def stream_hourly_alerts(pred: DataFrame, thr: DataFrame, watermark: str = "3 hours", cell: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """The figures of heat.hourly_alerts for each hour of a stream of cells (time, cell, pred_c). thr (cell, thr) is a static table."""
    v, rows = C.finite(F.col("pred_c")), pred.withWatermark("time", watermark).join(thr, list(cell))
    over = F.coalesce((v > F.col("thr")).cast("int"), F.lit(0))
    above = F.when(v.isNotNull(), F.greatest(v - F.col("thr"), F.lit(0.0)))
    out = rows.groupBy(F.window("time", "1 hour")).agg(
        F.avg(over.cast("double")).alias("exceed_fraction"), F.sum(over).cast("bigint").alias("affected_cells"), F.count("*").alias("total_cells"), F.avg(v).alias("mean_pred_c"), F.max(v).alias("max_pred_c"),
        F.avg(above).alias("mean_exceedance_c"), F.max(v - F.col("thr")).alias("max_exceedance_c"),
    )
    return out.select(F.col("window.start").alias("time"), *out.columns[1:]).withColumn("alert_level", C.alert_level(F.col("exceed_fraction")))


def stream_daily_maxima(pred: DataFrame, watermark: str = "1 day", cell: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """day, cell, pred_c: each cell's maximum of each day so far; days older than the watermark leave the state. For update mode."""
    rows = pred.withWatermark("time", watermark)
    out = rows.groupBy(F.window("time", "1 day"), *cell).agg(F.max(C.finite(F.col("pred_c"))).alias("pred_c"))
    return out.select(F.to_date("window.start").alias("day"), *cell, "pred_c")


def stream_daily_alerts(pred: DataFrame, thr: DataFrame, store: str, out: str, watermark: str = "1 day", cell: tuple[str, ...] = ("y", "x"), fan: int = 4, keep_days: int = 7) -> DataStreamWriter:
    """A writer that keeps the cells' maxima in a DayStore under store and writes the alerts of all days that a batch touched under out/batch=<n>; of a day the last batch counts.

    A batch reads fewer than `fan` runs of each of its days, however many batches there were. keep_days has to be longer than the watermark.
    """
    days = DayStore(store, cell, "pred_c", fan, keep_days)

    def update(batch: DataFrame, n: int) -> None:
        newest = days.update(batch, n)
        heat._alerts(newest.join(thr, list(cell)), "day", "pred_c").write.mode("overwrite").parquet(f"{out}/batch={n}")

    return stream_daily_maxima(pred, watermark, cell).writeStream.outputMode("update").foreachBatch(update)


def latest_of_batches(df: DataFrame, key: str = "day") -> DataFrame:
    """Rows of the last batch that wrote each key."""
    return heat.latest(df, [key], "batch").drop("batch")


def stream_station_hourly(obs: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """time, station_id, obs_c, n_obs_raw of each hour of a stream of readings; later ones than the watermark are dropped."""
    rows = obs.withColumn("obs_c", C.finite(F.col("obs_c"))).where("obs_c is not null").withWatermark("time", watermark)
    out = rows.groupBy(F.window("time", "1 hour"), "station_id").agg(F.avg("obs_c").alias("obs_c"), F.count("*").alias("n_obs_raw"))
    return out.select(F.col("window.start").alias("time"), "station_id", "obs_c", "n_obs_raw")


def notify_once(alerts: DataFrame, min_level: str = "warning", watermark: str | None = None) -> DataFrame:
    """alerts at or over a level with notify_key and channels, once for each time, level and active flag. With a watermark for streams, else for tables."""
    rows = alerts.where(C.level_rank(F.col("alert_level")) >= C.LEVELS.index(min_level))
    channels = F.create_map(*[x for k, v in CHANNELS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    rows = rows.withColumn("notify_key", F.concat_ws(":", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss"), "alert_level", F.col("active").cast("string")))
    rows = rows.withColumn("channels", F.try_element_at(channels, F.col("alert_level")))
    return rows.withWatermark("time", watermark).dropDuplicatesWithinWatermark(["notify_key"]) if watermark else rows.dropDuplicates(["notify_key"])


def with_dynamic_thresholds(stream: DataFrame, history: DataFrame) -> DataFrame:
    """Rows (time, ...) with the thresholds of their month and hour; base ones where history has none."""
    table = heat.dynamic_thresholds(history).drop("n").withColumnsRenamed({"month": "__m", "hour": "__h"})
    joined = stream.join(table, (F.month("time") == F.col("__m")) & (F.hour("time") == F.col("__h")), "left").drop("__m", "__h")
    return joined.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in heat.BASE.items()})


def deliver(rows: DataFrame, path: str) -> DataStreamWriter:
    """A writer that delivers each batch of rows once under path, also if a batch is written again after a crash (see outbox)."""
    rows.sparkSession.dataSource.register(Outbox)
    return rows.writeStream.format("outbox").option("path", path).outputMode("append")


def in_order(rows: DataFrame, key: str, processor: InOrder, watermark: str) -> DataFrame:
    """The processor's rows for a stream (key, time, more), with its times as timestamps. Needs a state store that keeps timers: see `timers`."""
    taken = rows.withColumn("at", F.unix_micros("time")).withWatermark("time", watermark)
    out = taken.groupBy(key).transformWithStateInPandas(processor, processor.out_schema, "append", "eventTime")
    stamp = lambda c: F.timestamp_micros(F.col(c)).alias("time" if c == "at" else c)
    return out.select(F.col("key").alias(key), *[stamp(c) if c in ("at", "start", "end") else c for c in processor.columns[1:]])


def stream_anomalies(stats: DataFrame, key: str = "model", watermark: str = "3 hours", silence_h: float = 24 * 7) -> DataFrame:
    """key, time and the anomalies of sampling.anomalies, null where there is none, for each row (key, time, mean, max) once the watermark has passed it.

    Rows that come out of order are taken in order; those older than the watermark are dropped. The state of a key is the rows that wait and the last 23 taken; it goes after
    silence_h hours of event time without a row, and the key begins anew.
    """
    rows = stats.select(F.col(key).cast("string").alias(key), "time", F.col("mean").cast("double").alias("mean"), F.col("max").cast("double").alias("max"))
    return in_order(rows, key, Anomalies(int(silence_h * HOUR)), watermark)


def stream_heat_events(alerts: DataFrame, key: str = "model", min_h: float = 6, cooldown_h: float = 12, watermark: str = "3 hours", silence_h: float = 48) -> DataFrame:
    """key, time, event_status, start, end, peak_level, peak_temp, peak_area for each row (key, time, alert_level, max_pred_c, exceed_fraction) that opens, changes, ends or discards an event.

    As heat.heat_events_cooldown with the same silence_h: rows are taken in order of time once the watermark has passed them, older ones are dropped, and an event whose key falls
    silent ends silence_h hours after its last row, by a timer; then the key's state goes.
    """
    double = lambda c, name: F.col(c).cast("double").alias(name)
    rows = alerts.select(F.col(key).cast("string").alias(key), "time", "alert_level", double("max_pred_c", "temp"), double("exceed_fraction", "area"))
    return in_order(rows, key, HeatEvents(min_h, cooldown_h, int(silence_h * HOUR)), watermark)


STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def timers(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB, which timers need."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def finish(writer: DataStreamWriter, checkpoint: str, spark: SparkSession) -> list[dict]:
    """Runs a stream over all of its available input; the progress of its batches."""
    with timers(spark):
        running = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        running.awaitTermination()
    return running.recentProgress


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All of a stream's available input, each batch written as out/batch=<n>; the table of all batches, whose attribute `progress` has that of the batches."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    progress = finish(stream.writeStream.outputMode(mode).foreachBatch(write), checkpoint, stream.sparkSession)
    table = stream.sparkSession.read.parquet(out)
    table.progress = progress
    return table


def state_rows(progress: list) -> list[int]:
    """Rows of state after each batch, over all stateful operators."""
    return [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in progress]
