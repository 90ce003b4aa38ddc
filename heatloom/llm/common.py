"""Helpers that all operators of this package share."""

from __future__ import annotations

import atexit
import os
import pickle
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local one serves a local master; a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = os.path.join(tempfile.gettempdir(), "heatloom-shared")
        os.makedirs(found, exist_ok=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Tables of this process that are still there, by path.
_TABLES: dict[str, SparkSession] = {}


#: Spark deletes a query's shuffle files at its end, not when the driver next collects garbage.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts lineage and survives lost executors. The shuffle files of its making go at once.

    `drop` deletes it; what the caller's result still reads goes when the program ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    _TABLES[path] = spark
    before = spark.conf.get(CLEAN_SHUFFLES)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def drop(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for table in tables:
        delete(table.stored_at)


def delete(path: str) -> None:
    spark = _TABLES.pop(path, None)
    if spark is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def delete_all() -> None:
    for path, spark in list(_TABLES.items()):
        if spark.sparkContext._jsc is not None:
            delete(path)


def keyed(docs: DataFrame) -> DataFrame:
    """row (all columns of docs but text, in a struct, so that no name of theirs can clash), text, and k1, k2: a key of doc_id and text. A null doc_id counts as the smallest long."""
    own = F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "text"])
    k1 = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)))
    return docs.select(own.alias("row"), "text", k1.alias("k1"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k2"))


def unkeyed(rows: DataFrame, columns: list[str], text: Column | None = None, more: list[Column] = ()) -> DataFrame:
    """The columns of keyed rows as they were, with another text if one is given, and more columns after them."""
    new = F.col("text") if text is None else text
    return rows.select(*(new.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in columns), *more)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trained(sample: DataFrame, fit):
    """fit(rows as dicts) run in one task over a bounded sample (ordered and limited by the caller): its result."""

    def run(batches):
        model = fit(row for batch in batches for row in batch.to_pylist())
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    found = sample.coalesce(1).mapInArrow(run, "model binary").first()
    return fit(iter(())) if found is None else pickle.loads(found.model)


def texts_of(batch, column: str = "text") -> list[str]:
    """The strings of an Arrow batch; null is the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]
