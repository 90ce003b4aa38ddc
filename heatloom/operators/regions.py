"""Work on each target with its k nearest points of a plane, a tile of targets at a time.

Points are counted in squares of all sizes. For each tile of targets, squares are refined from coarse to fine: those that certainly hold k points bound how far
any target's k nearest can be, and squares beyond that bound are left. So a tile meets few points besides its own neighbours, also where the nearest ones lie
far away, as around a block that is held out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatloom.functions import columns as C
from heatloom.sources import io

#: The smallest square is this many halvings of the field, at most; halvings at a time; distances that a task holds at once.
LEVELS, STEP, AT_ONCE = 18, 3, 1 << 21


def k_nearest(d2: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k smallest of each row, in order of the columns; equal ones go to the first columns."""
    if d2.shape[1] <= k:
        return np.tile(np.arange(d2.shape[1]), (len(d2), 1))
    last = np.partition(d2, k - 1, axis=1)[:, k - 1 : k]
    less, equal = d2 < last, d2 == last
    kept = less | (equal & (np.cumsum(equal, axis=1) <= k - less.sum(1, keepdims=True)))
    return np.nonzero(kept)[1].reshape(-1, k)


def with_neighbours(targets: DataFrame, points: DataFrame, by: list[str], k: int, work: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """by and what work(targets, points, near) gives (schema) for batches of targets (by, id, x, y, ...) of a tile and points (by, id, x, y, ...) of the same by.

    near holds the numbers of each target's k nearest points by rising id; equal distances go to smaller ids, and there are fewer where by has fewer points. Targets and points without a
    finite place take no part, nor targets whose by has no points. id names a point within by. A tile holds a few times k points, unless these share one spot; a group is a tile's targets and the points within its bound.
    """
    placed = lambda df: df.withColumns({c: C.finite(F.col(c).cast("double")) for c in "xy"}).where("x is not null and y is not null")
    targets, points = placed(targets), placed(points)
    xy = points.select("x", "y").unionAll(targets.select("x", "y"))
    x0, x1, y0, y1 = xy.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    out_schema = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in by) + f", {schema}"
    if x0 is None:
        return points.sparkSession.createDataFrame([], out_schema)
    width = max(x1 - x0, y1 - y0) * (1 + 1e-9) or 1.0
    deepest = 1 << LEVELS
    at = lambda c, low: F.least(F.floor((F.col(c) - low) / width * deepest), F.lit(deepest - 1)).cast("int")
    counted = io.written(points.groupBy(*by, at("x", x0).alias("__cx"), at("y", y0).alias("__cy")).agg(F.count("*").alias("__n")), "squares")
    up = lambda c, level: F.expr(f"shiftright({c}, {LEVELS} - {level})").alias(c)
    sizes = counted.select(*by, "__n", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("__l"), "__cx", "__cy").groupBy(*by, "__l", up("__cx", "__l"), up("__cy", "__l"))
    fullest = sizes.agg(F.sum("__n").alias("__n")).groupBy("__l").agg(F.max("__n").alias("n")).collect()
    level = min((r["__l"] for r in fullest if r.n <= 4 * k), default=LEVELS)
    side = lambda at_level: width / (1 << at_level)
    own = lambda df, x, y: df.withColumns({x: F.expr(f"shiftright({x}, {LEVELS - level})"), y: F.expr(f"shiftright({y}, {LEVELS - level})")})
    dealt = own(targets.withColumns({"__tx": at("x", x0), "__ty": at("y", y0)}), "__tx", "__ty")
    near = own(points.withColumns({"__cx": at("x", x0), "__cy": at("y", y0)}), "__cx", "__cy")
    tile, square = [*by, "__tx", "__ty"], [*by, "__cx", "__cy"]

    def measured(pairs: DataFrame, at_level: int) -> DataFrame:
        """pairs of tiles and squares that no bound rules out."""
        s, t = side(at_level), side(level)
        gap = lambda c, v: F.greatest(F.lit(0.0), F.col(c) * s - (F.col(v) + 1) * t, F.col(v) * t - (F.col(c) + 1) * s)
        far = lambda c, v: F.greatest((F.col(c) + 1) * s - F.col(v) * t, (F.col(v) + 1) * t - F.col(c) * s)
        hold = lambda f: F.hypot(f("__cx", "__tx"), f("__cy", "__ty"))
        enough: Column = F.sum("__n").over(Window.partitionBy(*tile).orderBy("__far")) >= k
        rows = pairs.withColumns({"__gap": hold(gap), "__far": hold(far)}).withColumn("__enough", enough)
        bound = F.min(F.when(F.col("__enough"), F.col("__far"))).over(Window.partitionBy(*tile))
        kept = rows.withColumn("__r", bound).where(F.col("__r").isNull() | (F.col("__gap") <= F.col("__r") * (1 + 1e-9) + width * 1e-12))
        return kept.select(*tile, "__cx", "__cy")

    counts_at = lambda at_level: counted.groupBy(*by, up("__cx", at_level), up("__cy", at_level)).agg(F.sum("__n").alias("__n"))
    first = level % STEP
    tiles = dealt.select(*[F.col(c).alias(c) for c in tile]).distinct()  # columns of their own, for the last join
    pairs = measured(tiles.join(counts_at(first), by), first)
    for at_level in range(first + STEP, level + 1, STEP):
        parent = [F.expr(f"shiftright({c}, {STEP})").alias(f"__p{c[-1]}") for c in ("__cx", "__cy")]
        finer = counts_at(at_level).select("*", *parent)
        coarse = pairs.select(*tile, F.col("__cx").alias("__px"), F.col("__cy").alias("__py"))
        pairs = measured(coarse.join(finer, [*by, "__px", "__py"]), at_level)
    met = pairs.join(near, square).drop("__cx", "__cy")

    def one(t: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(t) and len(p):
            t, p = t.sort_values("id"), p.sort_values("id")
            place = p[["x", "y"]].to_numpy()
            step = max(1, AT_ONCE // len(p))
            for s in range(0, len(t), step):
                some = t.iloc[s : s + step]
                d2 = ((some[["x", "y"]].to_numpy()[:, None, :] - place[None]) ** 2).sum(-1)
                got = work(some, p, k_nearest(d2, k))
                parts.append(got.assign(**{c: t[c].iloc[0] for c in by}))
        return pd.concat(parts)[names] if parts else pd.DataFrame(columns=names)

    names = points.sparkSession.createDataFrame([], out_schema).columns
    # small rows, dear work: the session's number of partitions, which isn't lowered by their bytes
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, *tile).groupBy(*tile).cogroup(met.repartition(tasks, *tile).groupBy(*tile)).applyInPandas(one, out_schema)
