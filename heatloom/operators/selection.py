"""Exact percentiles of whole columns, by counts in bins and then the one bin that holds the rank.

Spark's own `percentile` keeps all distinct values of a column in one task. Here a pass counts a column's values in equal bins between the ends known so far; the
bin that holds the rank gives the next ends. Once a bin holds few values, they are sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatloom.functions import columns as C

#: Bins of a pass, and the number of values that are sorted at once.
BINS, FEW = 4_096, 20_000


def at_ranks(rows: DataFrame, wanted: dict[str, set[int]], ends: dict[str, tuple[float, float]], bins: int = BINS, few: int = FEW) -> dict[tuple[str, int], float]:
    """The values at some ranks (from 0) of each column of rows (variable, value). The driver gets at most `bins` counts a rank that is sought."""
    spark, found = rows.sparkSession, {}
    # a target: its column, rank, rank inside what is left, and the ends of that
    open_ = [(c, r, r, *ends[c], None) for c, ranks in wanted.items() for r in sorted(ranks)]
    while open_:
        left = []
        for c, r, inner, low, high, n in open_:
            if low == high:
                found[c, r] = low
            else:
                left.append((c, r, inner, low, high, n))
        if not left:
            break
        ranges = sorted({(c, low, high, n is not None and n <= few) for c, _, _, low, high, n in left})
        number = {(c, low, high): k for k, (c, low, high, _) in enumerate(ranges)}
        table = F.broadcast(spark.createDataFrame([(k, *t) for k, t in enumerate(ranges)], "k int, variable string, low double, high double, sort boolean"))
        inside = rows.join(table, "variable").where("value >= low and value <= high")
        # halves keep the difference of two large numbers finite
        place = (F.col("value") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        bin_ = F.least(F.floor(place * bins), F.lit(bins - 1)).cast("int")
        counts: dict[int, list] = {}
        for row in inside.where("not sort").groupBy("k", bin_.alias("b")).agg(F.count("*").alias("n"), F.min("value").alias("a"), F.max("value").alias("z")).collect():
            counts.setdefault(row.k, []).append((row.b, row.n, row.a, row.z))
        values = {row.k: row.v for row in inside.where("sort").groupBy("k").agg(F.sort_array(F.collect_list("value")).alias("v")).collect()} if any(t[3] for t in ranges) else {}
        open_ = []
        for c, r, inner, low, high, _ in left:
            k = number[c, low, high]
            if k in values:
                found[c, r] = values[k][inner]
                continue
            for _, n, a, z in sorted(counts[k]):
                if inner < n:
                    open_.append((c, r, inner, a, z, n))
                    break
                inner -= n
    return found


def percentiles(df: DataFrame, columns: dict[str, Column], parts: list[float], bins: int = BINS, few: int = FEW) -> dict[str, dict]:
    """For each named column: `min`, `max` and `at`, the list of its exact percentiles, between neighbours by distance; nulls where it has no finite value.

    Three passes over df where a column's values are spread, more where most lie in a small part of their range; each reads these columns alone. No task or
    driver holds a column: counts of `bins` bins a rank, and at most `few` values to sort.
    """
    named = df.select(*[C.finite(v.cast("double")).alias(c) for c, v in columns.items()])
    rows = named.unpivot([], list(columns), "variable", "value").where("value is not null")
    stats = {r.variable: r for r in rows.groupBy("variable").agg(F.count("*").alias("n"), F.min("value").alias("a"), F.max("value").alias("z")).collect()}
    wanted = {c: {f(p * (r.n - 1)) for p in parts for f in (math.floor, math.ceil)} for c, r in stats.items()}
    got = at_ranks(rows, wanted, {c: (r.a, r.z) for c, r in stats.items()}, bins, few)

    def value(c: str, p: float) -> float:
        place = p * (stats[c].n - 1)
        low, high = math.floor(place), math.ceil(place)
        a, b = got[c, low], got[c, high]
        return a if a == b else (high - place) * a + (place - low) * b

    none = {"min": None, "max": None, "at": [None] * len(parts)}
    return {c: {"min": stats[c].a, "max": stats[c].z, "at": [value(c, p) for p in parts]} if c in stats else none for c in columns}
