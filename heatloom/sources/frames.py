"""A Spark data source for folders of .npy frames named by their times.

Files are listed and named files' times tested at planning: filters on `time` drop whole files, so the bytes read fall with them. Files are dealt to
partitions by size; a task reads a file's head first and refuses a frame of another shape before it reads the cells.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Fixed value: a time in a file's name.
NAME_TIME = re.compile(r"(\d{4})[-_T:](\d{2})[-_T:](\d{2})[-_T:](\d{2})[-_T:](\d{2})(?:[-_T:](\d{2}))?")
#: Bytes of a partition's files, and of a file's head that are read for its shape at first.
PARTITION, HEAD = 128 << 20, 4_096
SCHEMA = "time timestamp, y int, x int, pred_c double"


def name_time(name: str) -> datetime | None:
    """The time in a file's name, as one of UTC; None without one or where it is no time."""
    found = NAME_TIME.search(name)
    try:
        return datetime(*(int(p or 0) for p in found.groups()), tzinfo=UTC) if found else None
    except ValueError:
        return None


def at_utc(value) -> datetime:
    """A filter's or option's time; without a zone it is one of UTC."""
    at = value if isinstance(value, datetime) else datetime.fromisoformat(str(value).replace(" ", "T"))
    return at if at.tzinfo else at.replace(tzinfo=UTC)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


def shape_of(f) -> tuple[tuple[int, ...], bool, np.dtype]:
    """Shape, whether columns come first, and type, from a file's head of any format version (1.0 to 3.0)."""
    version = np.lib.format.read_magic(f)
    if version == (1, 0):
        return np.lib.format.read_array_header_1_0(f)
    if version == (2, 0):
        return np.lib.format.read_array_header_2_0(f)
    if version != (3, 0):
        raise ValueError(f"a .npy file of format {version}")
    length = int.from_bytes(f.read(4), "little")
    text = f.read(length).decode("utf-8")
    head = ast.literal_eval(text)
    return head["shape"], head["fortran_order"], np.lib.format.descr_to_dtype(head["descr"])


def plane(shape: tuple[int, ...]) -> tuple[int, int]:
    """Rows and columns of a frame; H x W x 1 is H x W."""
    if len(shape) == 3 and shape[2] == 1:
        shape = shape[:2]
    if len(shape) != 2:
        raise ValueError(f"a frame of shape {shape}")
    return shape


@dataclass
class Files(InputPartition):
    """Paths and times of a partition's files, and the shape that all have."""

    files: list[tuple[str, datetime]]
    shape: tuple[int, int]


class FrameReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.pattern = options["path"], options.get("pattern", "*.npy")
        self.size = int(options.get("partitionbytes", PARTITION))
        self.tests: list[tuple[str, list[datetime]]] = [(op, [at_utc(options[k])]) for k, op in (("start", ">="), ("end", "<")) if options.get(k)]

    def wanted(self, at: datetime) -> bool:
        ask = {"=": at.__eq__, ">": at.__gt__, ">=": at.__ge__, "<": at.__lt__, "<=": at.__le__}
        return all(at in values if op == "in" else ask[op](values[0]) for op, values in self.tests)

    def partitions(self) -> list[Files]:
        system, root = opened(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        named = [(f.path, name_time(f.base_name), f.size) for f in found if f.type == fs.FileType.File and fnmatch(f.base_name, self.pattern)]
        files = sorted((at, path, size) for path, at, size in named if at is not None and self.wanted(at))
        if not files:
            return []
        with system.open_input_stream(files[0][1], buffer_size=HEAD) as f:
            shape = plane(shape_of(f)[0])
        parts, held = [Files([], shape)], 0
        for at, path, size in files:
            if held and held + size > self.size:
                parts.append(Files([], shape))
                held = 0
            parts[-1].files.append((path, at))
            held += size
        return parts

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        system, _ = opened(self.path)
        h, w = partition.shape
        y, x = (pa.array(a.ravel().astype(np.int32)) for a in np.indices((h, w)))
        for path, at in partition.files:
            with system.open_input_stream(path, buffer_size=HEAD) as f:
                shape, by_column, kind = shape_of(f)
                if plane(shape) != (h, w):
                    raise ValueError(f"frames have different shapes: {path} is {shape}, another one {(h, w)}")
                if kind.hasobject:
                    raise ValueError(f"{path} holds objects")
                cells = np.frombuffer(f.read(), kind, h * w).reshape((h, w), order="F" if by_column else "C").astype(np.float64)
            time = pa.array([at], pa.timestamp("us", "UTC")).take(pa.array(np.zeros(h * w, np.int32)))
            yield pa.RecordBatch.from_arrays([time, y, x, pa.array(cells.ravel(), from_pandas=True)], ["time", "y", "x", "pred_c"])


class PushingReader(FrameReader):
    """A reader that takes filters on time. Spark refuses one where spark.sql.python.filterPushdown.enabled is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """A file's name decides each test of its time, so such filters needn't be tested again."""
        kinds = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if getattr(f, "attribute", None) == ("time",) and type(f) in kinds:
                self.tests.append((kinds[type(f)], [at_utc(f.value)]))
            elif isinstance(f, In) and f.attribute == ("time",):
                self.tests.append(("in", [at_utc(v) for v in f.value]))
            else:
                yield f


class NpyFrames(DataSource):
    """Format `npy_frames`. Options: path; pattern (*.npy); start and end (from, and before; UTC); partitionBytes; push (true: filters on time drop files too, for which
    spark.sql.python.filterPushdown.enabled must be on). Names without a time are skipped."""

    @classmethod
    def name(cls) -> str:
        return "npy_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        options = {k.lower(): v for k, v in self.options.items()}
        return (PushingReader if options.get("push") == "true" else FrameReader)(options)
