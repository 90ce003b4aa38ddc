"""A log-structured store of the cells' maxima by day: each batch adds a run to the days it touches, and full days are merged into one run.

store/runs/batch=<n>/day=<d>      the rows that batch n wrote for day d: what is new, or all of the day if its runs were merged
store/list/<n>                    the live runs of each open day after batch n, as JSON

Batch n reads the list of batch n - 1 and writes its own, so a batch that is run again after a failure gives the same store. A day has fewer
than `fan` live runs, whatever the number of batches; days older than `keep_days` before the newest one leave the list.
"""

from __future__ import annotations

import json
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class DayStore:
    """Maxima (day, cell, value) of batches. cell: the columns that name a cell."""

    def __init__(self, path: str, cell: tuple[str, ...], value: str = "pred_c", fan: int = 4, keep_days: int = 7):
        self.path, self.cell, self.value, self.fan, self.keep_days = path.rstrip("/"), list(cell), value, fan, keep_days

    def runs(self, spark: SparkSession, n: int) -> dict[str, list[str]]:
        """The live runs by day after batch n; none before the first batch."""
        if n < 0:
            return {}
        return json.loads(spark.read.text(f"{self.path}/list/{n}", wholetext=True).first().value)

    def newest(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("day", *self.cell).agg(F.max(self.value).alias(self.value))

    def read(self, spark: SparkSession, days: list[str], runs: dict[str, list[str]], schema) -> DataFrame | None:
        """The rows of the live runs of these days, and of no others."""
        paths = [f"{self.path}/runs/{run}/day={day}" for day in days for run in runs.get(day, [])]
        if not paths:
            return None
        return spark.read.schema(schema).option("basePath", f"{self.path}/runs").parquet(*paths).drop("batch")

    def update(self, batch: DataFrame, n: int) -> DataFrame:
        """Adds the rows of batch n; all maxima of the days that it touches. The days of a batch are few: the watermark bounds them."""
        spark, columns = batch.sparkSession, ["day", *self.cell, self.value]
        schema = batch.select(*[c for c in columns if c != "day"], "day").schema
        days = sorted(str(r.day) for r in batch.select("day").distinct().collect())
        before = self.runs(spark, n - 1)
        full = [d for d in days if len(before.get(d, [])) + 1 >= self.fan]
        old = self.read(spark, full, before, schema)
        rows = batch.select(*columns)
        if old is not None:
            merged = self.newest(rows.where(F.col("day").cast("string").isin(full)).unionByName(old.select(*columns)))
            rows = rows.where(~F.col("day").cast("string").isin(full)).unionByName(merged)
        rows.repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/runs/batch={n}")
        live = before | {d: ([] if d in full else before.get(d, [])) + [f"batch={n}"] for d in days}
        last = max(map(date.fromisoformat, live), default=None)
        live = {d: r for d, r in live.items() if date.fromisoformat(d) >= last - timedelta(days=self.keep_days) or d in days}
        spark.createDataFrame([(json.dumps(live, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/list/{n}")
        found = self.read(spark, days, live, schema)
        return self.newest(found) if found is not None else rows.limit(0)
