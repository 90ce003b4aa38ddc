"""The .npy data source: formats, shapes, filters that drop files."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from heatloom.sources import io
from heatloom.sources.frames import FrameReader, NpyFrames, PushingReader, name_time

UTC = dt.UTC


def save(path, frame, version=None):
    with open(path, "wb") as f:
        np.lib.format.write_array(f, frame, version=version)


@pytest.fixture
def maps(tmp_path):
    folder = tmp_path / "maps" / "deep"
    folder.mkdir(parents=True)
    for day in range(1, 11):
        frame = np.arange(6.0).reshape(2, 3) + day
        save(folder / f"p_2024-07-{day:02d}_10-00.npy", np.asfortranarray(frame) if day == 4 else frame.reshape(2, 3, 1) if day == 5 else frame.astype("f4") if day == 6 else frame, {1: (1, 0), 2: (2, 0), 3: (3, 0)}.get(day))
    save(folder / "mean.npy", np.zeros((9, 9)))
    save(folder / "p_2024-13-01_10-00.npy", np.zeros((9, 9)))
    (folder / "p_2024-07-01_10-00.txt").write_text("x")
    return str(tmp_path / "maps")


def test_formats_and_layouts(spark, maps):
    got = {(r.time.day, r.y, r.x): r.pred_c for r in io.read_prediction_maps(spark, maps).collect()}
    assert got == {(d, y, x): 3 * y + x + d for d in range(1, 11) for y in range(2) for x in range(3)}


def test_filters_drop_files(spark, maps):
    at = lambda d: dt.datetime(2024, 7, d, 10, tzinfo=UTC)
    size = lambda r: sum(len(p.files) for p in r.partitions())
    assert size(FrameReader({"path": maps})) == 10
    assert size(FrameReader({"path": maps, "start": "2024-07-03", "end": "2024-07-05 10:00:00"})) == 2
    reader = PushingReader({"path": maps})
    left = [EqualTo(("y",), 1)]
    assert list(reader.pushFilters([GreaterThanOrEqual(("time",), at(2)), LessThan(("time",), dt.datetime(2024, 7, 9)), In(("time",), (at(3), at(8), at(9))), *left])) == left
    assert size(reader) == 2
    assert len(FrameReader({"path": maps, "partitionbytes": "1"}).partitions()) == 10
    assert FrameReader({"path": maps, "start": "2030-01-01"}).partitions() == []
    assert io.read_prediction_maps(spark, maps, start="2024-07-10").count() == 6
    assert io.read_prediction_maps(spark, maps, start="2030-01-01").count() == 0


def test_filters_reach_the_source(spark, maps):
    frames = io.read_prediction_maps(spark, maps)
    df = frames.where((F.col("time") >= F.lit("2024-07-09").cast("timestamp")) & (F.col("y") == 1))
    assert sorted({r.time.day for r in df.collect()}) == [9, 10] and df.count() == 6
    spark.dataSource.register(NpyFrames)
    few = spark.read.format("npy_frames").option("partitionBytes", 1).option("push", "true").load(maps)
    assert few.rdd.getNumPartitions() == 10
    assert few.where(F.col("time") == F.lit("2024-07-03 10:00:00").cast("timestamp")).rdd.getNumPartitions() == 1


def test_shapes_must_agree(spark, maps):
    save(f"{maps}/p_2024-07-20_10-00.npy", np.zeros((4, 4)))
    with pytest.raises(Exception, match="different shapes"):
        io.read_prediction_maps(spark, maps).count()
    assert io.read_prediction_maps(spark, maps, end="2024-07-20").count() == 60  # a file that isn't read doesn't count


def test_name_time():
    assert name_time("a2024_01_02T03:04.npy") == dt.datetime(2024, 1, 2, 3, 4, tzinfo=UTC)
    assert name_time("a2024_01_02_03_04_05.npy") == dt.datetime(2024, 1, 2, 3, 4, 5, tzinfo=UTC)
    assert name_time("2024.npy") is None and name_time("2024-02-30_01-01.npy") is None
