"""A streaming sink that delivers each batch once: tasks stage files, and one marker for a batch makes them count.

path/staged/<name>.jsonl      what a task wrote; counts for nothing by itself
path/delivered/<n>.json       the files of batch n: written once, by the first commit of the batch

A task that fails or is run twice leaves a staged file that no marker names. When a batch is written again after a crash, its marker decides: if it is
there, the batch was delivered and the new files go; if not, the new files are delivered. Which rows are new at all is for the query's own state to say.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage


@dataclass
class Staged(WriterCommitMessage):
    """The file of a task, and the number of its rows."""

    name: str
    rows: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    system, root = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    return system, root.rstrip("/")


class OutboxWriter(DataSourceStreamWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> Staged:
        system, root = opened(self.path)
        name, rows, out = f"{uuid.uuid4().hex}.jsonl", 0, None
        try:
            for row in iterator:
                if out is None:
                    system.create_dir(f"{root}/staged", recursive=True)
                    out = system.open_output_stream(f"{root}/staged/{name}")
                out.write(json.dumps(row.asDict(recursive=True), default=str, sort_keys=True).encode() + b"\n")
                rows += 1
        finally:
            if out is not None:
                out.close()
        return Staged(name, rows)  # without rows there is no file

    def commit(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        system, root = opened(self.path)
        marker = f"{root}/delivered/{batchId}.json"
        if system.get_file_info(marker).type != fs.FileType.NotFound:
            self.abort(messages, batchId)
            return
        system.create_dir(f"{root}/delivered", recursive=True)
        done = [m for m in messages if m is not None and m.rows]
        part = f"{marker}.{uuid.uuid4().hex}.tmp"
        with system.open_output_stream(part) as out:
            out.write(json.dumps({"batch": batchId, "files": [m.name for m in done], "rows": sum(m.rows for m in done)}).encode())
        system.move(part, marker)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        system, root = opened(self.path)
        for m in messages:
            if m is not None and m.rows:
                system.delete_file(f"{root}/staged/{m.name}")


class Outbox(DataSource):
    """Format `outbox` for writeStream, option path: a folder that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "outbox"

    def streamWriter(self, schema, overwrite) -> OutboxWriter:  # noqa: N802
        return OutboxWriter(self.options["path"])


def delivered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all delivered batches, with their number as `batch`; staged files without a marker are not read."""
    markers = spark.read.schema("batch bigint, files array<string>, rows bigint").json(f"{path}/delivered/*.json")
    names = markers.selectExpr("batch", "explode(files) AS name")
    rows = spark.read.schema(schema).json(f"{path}/staged")
    named = rows.selectExpr("*", "_metadata.file_name AS name")
    return named.join(names, "name").drop("name")
