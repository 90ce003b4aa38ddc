"""Streams over several micro-batches: order, late rows, silence, restarts, bounded state; the day store and the outbox."""

import datetime as dt
import os
import random

import pytest

from heatloom.operators import heat, sampling
from heatloom.plans import live
from heatloom.streaming import alerts
from heatloom.streaming.day_store import DayStore
from heatloom.streaming.outbox import OutboxWriter, delivered

T0 = dt.datetime(2024, 7, 1)
HOUR = dt.timedelta(hours=1)
LEVELS = "model string, time timestamp, alert_level string, max_pred_c double, exceed_fraction double"


def write(spark, folder, rows, schema, n):
    """A file of rows for batch n."""
    path = f"{folder}/{n:03d}.parquet"
    os.makedirs(folder, exist_ok=True)
    table = spark.createDataFrame(rows, schema).toPandas()
    table["time"] = table["time"].dt.tz_localize("UTC").astype("datetime64[us, UTC]")
    table.to_parquet(path)
    os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))


def level_rows():
    rnd = random.Random(7)
    rows = []
    for model in "abc":
        at = T0
        for _ in range(150):
            at += HOUR * rnd.choice([1, 1, 1, 2, 5, 9, 30])
            rows.append((model, at, rnd.choice(["normal", "watch", "normal", "warning", "severe"] if rnd.random() < 0.4 else ["normal"]), rnd.uniform(20, 40), rnd.random()))
    return sorted(rows, key=lambda r: r[1])


def test_heat_events_over_batches(spark, tmp_path):
    """Rows out of order but inside the watermark count in order; older ones are dropped; a restart changes nothing; silence ends events and clears state."""
    rows, source = level_rows(), str(tmp_path / "in")
    want = heat.heat_events_cooldown(spark.createDataFrame(rows, LEVELS), ["model"], silence_h=20)
    want = {(r.model, r.start, r.end, r.peak_level, r.peak_temp, r.peak_area) for r in want.collect()}
    n, size = 0, 45
    batches = [rows[k : k + size] for k in range(0, len(rows), size)]
    for k in range(len(batches) - 1):
        batches[k][-1], batches[k + 1][0] = batches[k + 1][0], batches[k][-1]  # a row comes a batch too late, less than the watermark's delay
    stream = lambda: alerts.stream_heat_events(spark.readStream.schema(LEVELS).option("maxFilesPerTrigger", 1).parquet(source), silence_h=20, watermark="2 days")
    progress = []
    for k, part in enumerate(batches):
        random.Random(k).shuffle(part)
        write(spark, source, part, LEVELS, n)
        n += 1
        if k == 5:
            progress += alerts.drain(stream(), str(tmp_path / "out"), str(tmp_path / "check")).progress
    write(spark, source, [("a", T0 + HOUR, "severe", 99.0, 1.0), ("d", T0 + HOUR, "severe", 99.0, 1.0)], LEVELS, n)
    write(spark, source, [("z", rows[-1][1] + 2000 * HOUR, "normal", 0.0, 0.0)], LEVELS, n + 1)
    out = alerts.drain(stream(), str(tmp_path / "out"), str(tmp_path / "check"))
    progress += out.progress
    got = {(r.model, r.start, r.end, r.peak_level, r.peak_temp, r.peak_area) for r in out.where("event_status = 'ended'").collect()}
    assert len(progress) > 8 and want and got == want
    assert out.where("model = 'd' or peak_temp = 99").count() == 0
    kept = alerts.state_rows(progress)
    assert max(kept) < len(rows) / 2 and kept[-1] <= 3  # the row that waits, its timer
    assert sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"]) == 2


def test_anomalies_over_batches(spark, tmp_path):
    rnd = random.Random(3)
    schema, source = "model string, time timestamp, mean double, max double", str(tmp_path / "in")
    rows = sorted(((m, T0 + HOUR * k, rnd.gauss(25, 3), rnd.gauss(30, 4)) for m in "ab" for k in range(120)), key=lambda r: r[1])
    want = sampling.anomalies(spark.createDataFrame(rows, schema), ["model"]).collect()
    for n, k in enumerate(range(0, len(rows), 40)):
        write(spark, source, rows[k : k + 40], schema, n)
    write(spark, source, [("a", T0, 1000.0, 1000.0)], schema, 6)
    write(spark, source, [("z", T0 + HOUR * 5000, 1.0, 1.0)], schema, 7)
    stream = alerts.stream_anomalies(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
    out = alerts.drain(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    kind = lambda r: (r.model, r.time, *[None if r[c] is None else round(r[c], 6) for c in ("mean_jump", "max_jump", "mean_outlier", "rising_trend", "falling_trend")])
    key = lambda r: (r[0], r[1])
    assert sorted(map(kind, out.collect()), key=key) == sorted(map(kind, want), key=key)
    assert alerts.state_rows(out.progress)[-1] <= 3


def test_late_readings_are_dropped_and_state_stays_small(spark, tmp_path):
    schema, source = "time timestamp, station_id string, obs_c double", str(tmp_path / "in")
    rows = [(T0 + HOUR * k, s, float(k)) for k in range(240) for s in "abcd"]
    for n, k in enumerate(range(0, len(rows), 160)):
        write(spark, source, rows[k : k + 160], schema, n)
    write(spark, source, [(T0, "a", 500.0)], schema, 6)
    write(spark, source, [(T0 + HOUR * 9000, "", 0.0)], schema, 7)
    out = alerts.drain(alerts.stream_station_hourly(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), "2 hours"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted((r.time, r.station_id, r.obs_c) for r in out.collect()) == sorted(rows)
    kept = alerts.state_rows(out.progress)
    assert len(kept) > 6 and max(kept) <= 160 + 4 * 4 and kept[-1] == 1


def test_day_store(spark, tmp_path):
    """A day has few live runs whatever the number of batches, a batch that is run again changes nothing, old days leave the list."""
    rnd = random.Random(1)
    store, best = DayStore(str(tmp_path / "store"), ("y", "x"), fan=3, keep_days=2), {}
    for n in range(14):
        day = dt.date(2024, 7, 1 + n // 3)
        rows = [(day, rnd.randrange(3), rnd.randrange(3), rnd.random()) for _ in range(5)] + [(day - dt.timedelta(days=1), 0, 0, rnd.random())] * (n % 2)
        for d, y, x, v in rows:
            best[d, y, x] = max(best.get((d, y, x), 0), v)
        df = spark.createDataFrame(rows, "day date, y int, x int, pred_c double").groupBy("day", "y", "x").agg({"pred_c": "max"}).withColumnRenamed("max(pred_c)", "pred_c")
        days = {r[0] for r in rows}
        for _ in range(1 + (n in (4, 8))):  # run again after a crash
            got = {(r.day, r.y, r.x): r.pred_c for r in store.update(df, n).collect()}
            assert got == {k: v for k, v in best.items() if k[0] in days}
        live_runs = store.runs(spark, n)
        assert all(len(r) < 3 for r in live_runs.values()) and len(live_runs) <= 4
    empty = store.update(df.limit(0), 14)
    assert empty.count() == 0 and store.runs(spark, 14) == live_runs


def test_outbox_counts_a_batch_once(spark, tmp_path):
    from pyspark.sql import Row

    path = str(tmp_path / "box")
    rows = [Row(k="a", n=1), Row(k="b", n=2)]
    lost = OutboxWriter(path).write(iter(rows))  # a crash between write and commit
    writer = OutboxWriter(path)
    writer.commit([writer.write(iter(rows[:1])), writer.write(iter(rows[1:])), writer.write(iter([]))], 0)
    again = writer.write(iter(rows))  # a crash after the commit, before the query knows of it
    writer.commit([again], 0)
    failed = writer.write(iter(rows))
    writer.abort([failed, None], 1)
    writer.commit([writer.write(iter([Row(k="c", n=3)]))], 1)
    got = sorted(tuple(r) for r in delivered(spark, path, "k string, n bigint").collect())
    assert got == [("a", 1, 0), ("b", 2, 0), ("c", 3, 1)]
    left = set(os.listdir(f"{path}/staged"))
    assert lost.name in left and again.name not in left and failed.name not in left


def test_notifications_once_across_a_restart(spark, tmp_path):
    schema, source = "time timestamp, alert_level string, active boolean", str(tmp_path / "in")
    rows = [(T0 + HOUR * k, ["normal", "warning", "severe"][k % 3], True) for k in range(60)]
    for n, k in enumerate(range(0, 60, 12)):
        write(spark, source, rows[k : k + 12] + rows[max(0, k - 3) : k + 3], schema, n)  # with rows of the batch before
    write(spark, source, rows[:6], schema, 5)
    path, check = str(tmp_path / "box"), str(tmp_path / "check")
    stream = lambda: alerts.deliver(alerts.notify_once(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), "warning", "6 hours"), path)
    alerts.finish(stream(), check, spark)
    last = max(int(f) for f in os.listdir(f"{check}/commits") if f.isdigit())
    for name in (f"{check}/commits/{last}", f"{check}/commits/.{last}.crc"):  # the last batch was delivered, but the query didn't get to know
        os.remove(name)
    write(spark, source, [(T0 + HOUR * 61, "severe", True)], schema, 6)
    alerts.finish(stream(), check, spark)
    got = [r.notify_key for r in delivered(spark, path, "notify_key string").collect()]
    want = {f"{t:%Y-%m-%dT%H:%M:%S}:{level}:true" for t, level, _ in [*rows, (T0 + HOUR * 61, "severe", True)] if level != "normal"}
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("name", ["stream_station_hourly", "stream_heat_events"])
def test_replay_has_a_late_file(spark, name, monkeypatch):
    """The registered streams read six files in order, then rows that are too old: some are dropped."""
    found = []
    drain = alerts.drain
    monkeypatch.setattr(alerts, "drain", lambda *a: found.append(drain(*a)) or found[-1])
    getattr(live, name)(spark, "/root/testdata/sf0.001").count()
    progress = found[0].progress
    assert sum(p["numInputRows"] > 0 for p in progress) >= live.FILES + 2
    assert sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"]) > 0
