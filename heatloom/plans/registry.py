"""All registered queries of the library and the SQL twins that check them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from heatloom.plans import base, files, grids, heat, live, stats, verify

__all__ = ["files", "grids", "heat", "live", "stats", "verify", "oracle_sql", "queries"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
