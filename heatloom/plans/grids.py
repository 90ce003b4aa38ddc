"""Queries: cells, weights, upsampling, tiles, filling, repair and scores of fields."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from heatloom.functions import columns as C
from heatloom.operators import clean, grids, heat, sampling, scattered
from heatloom.plans.base import CELLS, GRID, HOURLY, OBS, STATIC, cells, grid, obs, query, static, table

PLACES = OBS + ", st AS (SELECT DISTINCT station_id, lat, lon FROM obs)"
AXES = "lats AS (SELECT CAST(i AS INT) AS i, 41.15 + 0.1 * i AS v FROM range(5) t(i)), lons AS (SELECT CAST(i AS INT) AS i, 2.3 - 0.1 * i AS v FROM range(4) t(i))"


def places(spark, d):
    return obs(spark, d).select("station_id", "lat", "lon").distinct()


def axes(spark):
    """Rows south to north, columns east to west."""
    i = F.col("id")
    return spark.range(5).select((41.15 + 0.1 * i).alias("value"), i.cast("int").alias("index")), spark.range(4).select((2.3 - 0.1 * i).alias("value"), i.cast("int").alias("index"))


@query(f"WITH {PLACES}, {AXES} SELECT station_id, arg_min(a.i, abs(a.v - lat) + a.i * 1e-12) AS y, arg_min(o.i, abs(o.v - lon) + o.i * 1e-12) AS x FROM st, lats a, lons o GROUP BY 1")
def nearest_cell(spark, d):
    """J3."""
    stations = places(spark, d).withColumns({"lat": F.col("lat") + 0.003, "lon": F.col("lon") + 0.003})
    return grids.nearest_cell(stations, *axes(spark)).select("station_id", "y", "x")


# The SQL twin reads the same shifted places.
from heatloom.plans.base import SQL  # noqa: E402

SQL["nearest_cell"] = SQL["nearest_cell"].replace("- lat)", "- (lat + 0.003))").replace("- lon)", "- (lon + 0.003))")

BILINEAR = PLACES + """, u AS (SELECT station_id, least(greatest((lat - 41.15) / 0.1, 0), 4) AS fy, least(greatest((2.3 - lon) / 0.1, 0), 3) AS fx FROM st),
c AS (SELECT station_id, least(CAST(floor(fy) AS INT), 3) AS y0, least(CAST(floor(fx) AS INT), 2) AS x0, fy, fx FROM u), w AS (SELECT station_id, y0, x0, fy - y0 AS wy, fx - x0 AS wx FROM c)"""


@query(
    f"""WITH {BILINEAR}, g AS (SELECT CAST(s_suppkey % 5 AS INT) AS y, CAST(s_suppkey // 5 % 4 AS INT) AS x, avg(s_acctbal) AS v FROM supplier GROUP BY 1, 2),
k AS (SELECT station_id, y0 + dy AS y, x0 + dx AS x, (CASE dy WHEN 0 THEN 1 - wy ELSE wy END) * (CASE dx WHEN 0 THEN 1 - wx ELSE wx END) AS share FROM w, (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dx))
SELECT station_id, CASE WHEN count(v) = count(*) THEN sum(v * share) END AS v FROM k LEFT JOIN g USING (y, x) GROUP BY 1 HAVING count(v) > 0""",
    "v",
)
def bilinear_extract(spark, d):
    """J4."""
    k = F.col("s_suppkey")
    field = table(spark, d, "supplier").groupBy((k % 5).cast("int").alias("y"), (F.floor(k / 5) % 4).cast("int").alias("x")).agg(F.avg("s_acctbal").alias("v"))
    return grids.weighted_extract(field, grids.bilinear_weights(places(spark, d), *axes(spark)), "v", [], whole=True)


FOOT = CELLS + """, s AS (SELECT station_id, CAST(CAST(station_id AS INT) % 10 AS INT) AS y, CAST(CAST(station_id AS INT) // 10 % 10 AS INT) AS x FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS station_id FROM events)),
f AS (SELECT station_id, y + dy AS y, x + dx AS x, exp(-(dy * dy + dx * dx) / 2.0) AS w FROM s, (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx) WHERE dy * dy + dx * dx <= 4)"""


@query(f"WITH {FOOT} SELECT station_id, sum(value * w) / sum(w) AS value FROM f JOIN cells USING (y, x) GROUP BY 1", "value")
def footprint_extract(spark, d):
    """J4b."""
    u = F.col("user_id")
    stations = table(spark, d, "events").select(u.cast("string").alias("station_id"), (u % 10).cast("int").alias("y"), (F.floor(u / 10) % 10).cast("int").alias("x")).distinct()
    return grids.weighted_extract(cells(spark, d), grids.footprint_weights(stations, 2, 1.0), "value", [])


@query(f"WITH {CELLS}, {AXES} SELECT y, x, value, arg_min(a.i, abs(a.v - lat) + a.i * 1e-12) AS gy, arg_min(o.i, abs(o.v - lon) + o.i * 1e-12) AS gx FROM (SELECT y, x, value, lat + 0.003 AS lat, lon + 0.003 AS lon FROM cells), lats a, lons o GROUP BY 1, 2, 3", "value")
def nearest_lr(spark, d):
    """J5."""
    moved = cells(spark, d).withColumns({"lat": F.col("lat") + 0.003, "lon": F.col("lon") + 0.003})
    lat, lon = axes(spark)
    return grids.nearest_on_axis(grids.nearest_on_axis(moved, lat, "lat", "gy"), lon, "lon", "gx").select("y", "x", "value", "gy", "gx")


IDW = HOURLY + ", " + CELLS + """, st AS (SELECT DISTINCT station_id, lat, lon FROM obs),
dd AS (SELECT y, x, station_id, greatest(sqrt(pow(c.lat - s.lat, 2) + pow(c.lon - s.lon, 2)), 1e-9) AS dist FROM cells c, st s), nn AS (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY dist, station_id) AS n FROM dd),
ww AS (SELECT y, x, station_id, 1 / (dist * dist) / sum(1 / (dist * dist)) OVER (PARTITION BY y, x) AS w FROM nn WHERE n <= 12),
mm AS (SELECT time, avg(obs_c) AS m FROM hourly GROUP BY 1),
full_ AS (SELECT mm.time, st.station_id, coalesce(f.obs_c, m, 0) AS obs_c FROM mm CROSS JOIN st LEFT JOIN hourly f ON f.time = mm.time AND f.station_id = st.station_id)"""


@query(f"WITH {IDW} SELECT time, y, x, sum(w * obs_c) AS t_c FROM full_ JOIN ww USING (station_id) GROUP BY 1, 2, 3", "t_c")
def idw(spark, d):
    """J6."""
    return grids.idw(heat.hourly_station_mean(obs(spark, d)), places(spark, d), cells(spark, d))


@query(f"WITH {PLACES}, {CELLS}, n AS (SELECT station_id, arg_min(y * 1000 + x, pow(c.lat - s.lat, 2) + pow(c.lon - s.lon, 2) + (y * 1000 + x) * 1e-15) AS k FROM st s, cells c GROUP BY 1) SELECT y, x, CAST(CASE WHEN y * 1000 + x IN (SELECT k FROM n) THEN 1 ELSE 0 END AS INT) AS mask FROM cells")
def station_mask(spark, d):
    """J17."""
    return grids.station_mask(cells(spark, d), places(spark, d)).select("y", "x", "mask")


@query(f"WITH {GRID}, t AS (SELECT DISTINCT time FROM grid), r AS (SELECT DISTINCT o_orderdate + INTERVAL 5 HOUR AS req FROM orders) SELECT req, coalesce((SELECT min(time) FROM t WHERE time >= req), (SELECT max(time) FROM t)) AS time FROM r")
def asof_next(spark, d):
    """J18."""
    wanted = table(spark, d, "orders").select((F.col("o_orderdate").cast("timestamp") + F.expr("interval 5 hours")).alias("req")).distinct()
    return grids.asof_next(grid(spark, d).select("time").distinct(), wanted)


@query(f"WITH {GRID}, {CELLS} SELECT c.y, c.x, c.value, k.m AS climatology FROM cells c JOIN (SELECT y, x, avg(t_c) AS m FROM grid GROUP BY 1, 2) k ON k.y = c.y AND k.x = c.x", "value climatology")
def climatology_static(spark, d):
    """A18, J19."""
    return grids.append_climatology(cells(spark, d).select("y", "x", "value"), grids.climatology(grid(spark, d)))


@query(f"WITH {PLACES}, {CELLS}, p AS (SELECT DISTINCT lat, lon, lat * 3 + lon AS f FROM st), n AS (SELECT y, x, lat, lon, row_number() OVER (PARTITION BY y, x ORDER BY d2, plat, plon) AS n, f FROM (SELECT c.y, c.x, c.lat, c.lon, p.lat AS plat, p.lon AS plon, f, pow(c.lat - p.lat, 2) + pow(c.lon - p.lon, 2) AS d2 FROM cells c, p)) SELECT y, x, f FROM n WHERE n = 1", "f")
def points_to_grid(spark, d):
    """G1."""
    points = places(spark, d).select("lat", "lon", (F.col("lat") * 3 + F.col("lon")).alias("f")).distinct()
    return grids.points_to_grid(points, cells(spark, d), ["f"])


FRAMES = "lr AS (SELECT vec_id, CAST((i - 1) // 8 AS INT) AS gy, CAST((i - 1) % 8 AS INT) AS gx, CAST(embedding[i] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))"


def frames(spark, d, y="gy", x="gx"):
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "value"))
    return rows.select("vec_id", F.floor(F.col("i") / 8).cast("int").alias(y), (F.col("i") % 8).cast("int").alias(x), F.col("value").cast("double").alias("value"))


AXIS = "SELECT o, CAST(floor(least(greatest((o + 0.5) * 0.5 - 0.5, 0), 7)) AS INT) AS a, least(greatest((o + 0.5) * 0.5 - 0.5, 0), 7) - floor(least(greatest((o + 0.5) * 0.5 - 0.5, 0), 7)) AS f FROM range(16) t(o)"


@query(
    f"""WITH {FRAMES}, ax AS ({AXIS}), w AS (SELECT CAST(o AS INT) AS o, a AS i, 1 - f AS w FROM ax UNION ALL SELECT CAST(o AS INT), least(a + 1, 7), f FROM ax)
SELECT vec_id, r.o AS y, c.o AS x, sum(r.w * c.w * value) AS value FROM lr JOIN w r ON r.i = gy JOIN w c ON c.i = gx GROUP BY 1, 2, 3""",
    "value",
)
def upsample_bilinear(spark, d):
    """G2."""
    return grids.upsample(frames(spark, d), (8, 8), (16, 16), ["vec_id"], "value")


@query(
    f"""WITH {FRAMES}, k AS (SELECT CAST(gy // 2 AS INT) AS gy, CAST(gx // 2 AS INT) AS gx, avg(value * 0.9) AS v FROM lr GROUP BY 1, 2), ax AS (SELECT CAST(o AS INT) AS o, least(greatest((o + 0.5) / 2 - 0.5, 0), 3) AS p FROM range(8) t(o)),
w AS (SELECT o, CAST(floor(p) AS INT) AS i, 1 - (p - floor(p)) AS w FROM ax UNION ALL SELECT o, CAST(floor(p) AS INT) + 1, p - floor(p) FROM ax WHERE p > floor(p)),
up AS (SELECT r.o AS y, c.o AS x, sum(r.w * c.w * v) AS v FROM k JOIN w r ON r.i = k.gy JOIN w c ON c.i = k.gx GROUP BY 1, 2), f AS (SELECT gy AS y, gx AS x, avg(value) AS m FROM lr GROUP BY 1, 2)
SELECT y, x, m - v AS value FROM f JOIN up USING (y, x)""",
    "value",
)
def residual_map(spark, d):
    """A18, the fine field's mean less the coarse one's."""
    hr = frames(spark, d, "y", "x")
    half = lambda c: F.floor(F.col(c) / 2).cast("int")
    lr = hr.select("vec_id", half("y").alias("gy"), half("x").alias("gx"), (F.col("value") * 0.9).alias("value"))
    return grids.residual_map(hr, lr, (4, 4), (8, 8), "value")


@query(f"WITH {FRAMES} SELECT vec_id, CAST(o.i AS INT) AS y, CAST(p.i AS INT) AS x, value FROM lr JOIN range(16) o(i) ON o.i // 2 = gy JOIN range(16) p(i) ON p.i // 2 = gx", "value")
def upsample_nearest(spark, d):
    return grids.upsample(frames(spark, d), (8, 8), (16, 16), ["vec_id"], "value", "nearest")


@query(f"WITH {GRID}, {CELLS}, e AS (SELECT y, x, avg(abs(pred_c - t_c)) AS v FROM grid GROUP BY 1, 2) SELECT c.y, c.x, coalesce(v, 0) AS value FROM cells c LEFT JOIN e ON e.y = c.y AND e.x = c.x", "value")
def error_map(spark, d):
    """A19."""
    return grids.error_map(grid(spark, d), cells(spark, d))


TILES = "tl AS (SELECT vec_id AS time, CAST(t // 2 * 4 AS INT) AS y0, CAST(t % 2 * 4 AS INT) AS x0, gy AS dy, gx AS dx, value + t AS value FROM lr, range(4) q(t))"


@query(f"WITH {FRAMES}, {TILES}, h AS (SELECT CAST(i AS INT) AS i, 0.5 - 0.5 * cos(2 * pi() * i / 7) AS w FROM range(8) t(i)) SELECT time, y0 + dy AS y, x0 + dx AS x, sum(greatest(a.w * b.w, 1e-6) * value) / sum(greatest(a.w * b.w, 1e-6)) AS value FROM tl JOIN h a ON a.i = dy JOIN h b ON b.i = dx GROUP BY 1, 2, 3", "value", 5)
def mosaic(spark, d):
    """A36."""
    t = F.explode(F.sequence(F.lit(0), F.lit(3)))
    tiles = frames(spark, d).withColumn("t", t).select(F.col("vec_id").alias("time"), (F.floor(F.col("t") / 2) * 4).cast("int").alias("y0"), (F.col("t") % 2 * 4).alias("x0"), F.col("gy").alias("dy"), F.col("gx").alias("dx"), (F.col("value") + F.col("t")).alias("value"))
    return grids.mosaic(tiles, 8)


@query("WITH f AS (SELECT DISTINCT CAST(60 + p_size * 4 AS INT) AS h, CAST(90 + p_partkey % 170 AS INT) AS w FROM part), y AS (SELECT h, w, unnest(list_distinct(list_append(range(0, greatest(h - 96, 0) + 1, 48), greatest(h - 96, 0)))) AS y0 FROM f) SELECT h, w, CAST(y0 AS INT) AS y0, CAST(unnest(list_distinct(list_append(range(0, greatest(w - 96, 0) + 1, 48), greatest(w - 96, 0)))) AS INT) AS x0 FROM y")
def tile_grid(spark, d):
    """R6, for frames of the sizes in a table."""
    sizes = table(spark, d, "part").select((60 + F.col("p_size") * 4).cast("int").alias("h"), (90 + F.col("p_partkey") % 170).cast("int").alias("w")).distinct()
    return grids.tile_grid(sizes)


@query(f"WITH {GRID}, r AS (SELECT time, CASE WHEN isnan(corr(pred_c, t_c)) THEN NULL ELSE corr(pred_c, t_c) END AS r FROM grid GROUP BY 1), s AS (SELECT avg(r) AS m, stddev_pop(r) AS sd FROM r) SELECT time, r, r < m - 2 * sd AS is_anomaly FROM r, s", "r")
def frame_correlation(spark, d):
    """A37."""
    return grids.frame_correlation(grid(spark, d))


MOVES = {"as_is": "gy, gx", "rot90": "7 - gx, gy", "rot180": "7 - gy, 7 - gx", "rot270": "gx, 7 - gy", "flip_y": "7 - gy, gx", "flip_x": "gy, 7 - gx", "transpose": "gx, gy", "transpose_flip_y": "7 - gx, gy", "transpose_flip_x": "gx, 7 - gy"}


@query(
    f"WITH {FRAMES}, m AS (" + " UNION ALL ".join(f"SELECT vec_id, '{k}' AS variant, value AS a, {v.split(', ')[0]} AS y, {v.split(', ')[1]} AS x FROM lr" for k, v in MOVES.items())
    + "), b AS (SELECT vec_id - 1 AS vec_id, gy AS y, gx AS x, value AS b FROM lr), r AS (SELECT vec_id, variant, corr(a, b) AS r FROM m JOIN b USING (vec_id, y, x) GROUP BY 1, 2) SELECT vec_id, variant, r, row_number() OVER (PARTITION BY vec_id ORDER BY round(r, 9) DESC, list_position([" + ", ".join(f"'{k}'" for k in MOVES) + "], variant)) = 1 AS is_best FROM r",
    "r",
)
def orientation_score(spark, d):
    """A40."""
    a = frames(spark, d, "y", "x")
    return grids.orientation_score(a, a.withColumn("vec_id", F.col("vec_id") - 1), 8, ["vec_id"])


@query(f"WITH {CELLS} SELECT y, x, value FROM cells WHERE y % 5 = 0 AND x % 5 = 0", "value")
def stride_grid(spark, d):
    """T6."""
    return grids.stride_grid(cells(spark, d), 5).select("y", "x", "value")


@query(f"WITH {STATIC} SELECT y, x FROM static, (SELECT CAST(ceil(greatest(max(y) + 1, max(x) + 1) / 16.0) AS INT) AS s FROM static) WHERE y % s = 0 AND x % s = 0")
def downsample(spark, d):
    return grids.downsample(static(spark, d), 16).select("y", "x")


HOLES = GRID + ", g AS (SELECT *, CASE WHEN (epoch(time) // 604800 + y * 3 + x) % 4 = 0 THEN NULL ELSE t_c END AS v FROM grid)"


def holes(spark, d):
    n = F.floor(F.unix_timestamp("time") / 604800) + F.col("y") * 3 + F.col("x")
    return grid(spark, d).withColumn("v", F.when(n % 4 == 0, F.lit(None)).otherwise(F.col("t_c")))


@query(
    f"""WITH {HOLES.replace('epoch(time)', 'CAST(epoch(time) AS BIGINT)')}, f AS (SELECT time, y, x, max(CASE WHEN v IS NOT NULL THEN x END) OVER (PARTITION BY time, y ORDER BY x) AS lo, min(CASE WHEN v IS NOT NULL THEN x END) OVER (PARTITION BY time, y ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM g)
SELECT f.time, f.y, f.x, CASE WHEN lo IS NOT NULL AND (hi IS NULL OR f.x - lo <= hi - f.x) THEN a.v ELSE b.v END AS v FROM f LEFT JOIN g a ON a.time = f.time AND a.y = f.y AND a.x = f.lo LEFT JOIN g b ON b.time = f.time AND b.y = f.y AND b.x = f.hi""",
    "v",
)
def nearest_fill(spark, d):
    """W8, one pass."""
    return grids.nearest_fill(holes(spark, d), "v", "x", ["time", "y"]).select("time", "y", "x", "v")


def near_sql(src: str, axis: str, within: str) -> str:
    """One pass over src (time, y, x, v): values known before and after along an axis, and the nearer of the two."""
    at = "epoch(time)" if axis == "time" else axis
    before = f"OVER (PARTITION BY {within} ORDER BY {axis} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    after = f"OVER (PARTITION BY {within} ORDER BY {axis} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    known = f"CASE WHEN v IS NOT NULL THEN {at} END"
    both = f"last_value(v IGNORE NULLS) {before} AS lv, max({known}) {before} AS lo, first_value(v IGNORE NULLS) {after} AS hv, min({known}) {after} AS hi"
    return f"SELECT time, y, x, CASE WHEN lo IS NOT NULL AND (hi IS NULL OR {at} - lo <= hi - {at}) THEN lv ELSE hv END AS v FROM (SELECT time, y, x, v, {both} FROM {src})"


PASSES = HOLES.replace("epoch(time)", "CAST(epoch(time) AS BIGINT)") + f", px AS ({near_sql('g', 'x', 'time, y')}), py AS ({near_sql('px', 'y', 'time, x')}), pt AS ({near_sql('py', 'time', 'y, x')})"


@query(f"WITH {PASSES} SELECT time, y, x, coalesce(v, avg(v) OVER (), 0) AS v FROM py", "v")
def fill_grid_fine(spark, d):
    """W8, a fine field: no pass over time, one mean."""
    return grids.fill_grid(holes(spark, d).select("time", "y", "x", "v"), "v", [], ("x", "y"))


@query(f"WITH {PASSES} SELECT time, y, x, coalesce(v, avg(v) OVER (), 0) AS v, 't2m' AS variable FROM pt", "v")
def fill_grid(spark, d):
    """W8, all passes."""
    return grids.fill_grid(holes(spark, d).select("time", "y", "x", "v").withColumn("variable", F.lit("t2m")), "v")


@query(
    f"""WITH {HOLES.replace('epoch(time)', 'CAST(epoch(time) AS BIGINT)')}, a AS (SELECT time, y, x, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY time, y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(v IGNORE NULLS) OVER (PARTITION BY time, y ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM g)
SELECT time, y, x, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY time, x ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(v IGNORE NULLS) OVER (PARTITION BY time, x ORDER BY y ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM a""",
    "v",
)
def directional_fill(spark, d):
    """W8b."""
    return grids.directional_fill(holes(spark, d).select("time", "y", "x", "v"), "v", ["time"])


@query(f"WITH {GRID}, j AS (SELECT time, abs(t_c - lag(t_c) OVER (PARTITION BY y, x ORDER BY time)) AS j FROM grid) SELECT time, max(j) AS max_jump FROM j GROUP BY 1", "max_jump")
def temporal_jump(spark, d):
    """W6."""
    return grids.temporal_jump(grid(spark, d).withColumnRenamed("t_c", "value"))


@query()
def repair_nan(spark, d):
    """W7."""
    return grids.repair_nan(holes(spark, d).select("y", "x", "time", F.col("v").alias("value")))


@query()
def ssim(spark, d):
    """A38, on frames of 16 x 16."""
    fine = grids.upsample(frames(spark, d), (8, 8), (16, 16), ["vec_id"], "value")
    near = grids.upsample(frames(spark, d), (8, 8), (16, 16), ["vec_id"], "value", "nearest")
    return grids.ssim(fine.withColumnRenamed("value", "pred_c").join(near.withColumnRenamed("value", "t_c"), ["vec_id", "y", "x"]), ["vec_id"])


@query()
def split_report(spark, d):
    """A39, with the similarity of 50 frames of 16 x 16."""
    fine = grids.upsample(frames(spark, d), (8, 8), (16, 16), ["vec_id"], "value").withColumnRenamed("value", "pred_c")
    near = grids.upsample(frames(spark, d), (8, 8), (16, 16), ["vec_id"], "value", "nearest").withColumnRenamed("value", "t_c")
    return grids.split_report(fine.join(near, ["vec_id", "y", "x"]).withColumnRenamed("vec_id", "time"))


@query(f"WITH {CELLS}, b AS (SELECT min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM cells WHERE y < 4 AND x < 4) SELECT y, x FROM cells, b WHERE lat BETWEEN a - 0.02 AND b + 0.02 AND lon BETWEEN c - 0.02 AND d + 0.02")
def clip_bbox(spark, d):
    """P6."""
    c = cells(spark, d)
    return clean.clip_bbox(c, c.where("y < 4 and x < 4"), 0.02).select("y", "x")


@query("SELECT l_linenumber AS g, CASE WHEN bool_and(v > b) THEN 'asc' WHEN bool_and(v < b) THEN 'desc' ELSE 'unknown' END AS axis_order FROM (SELECT l_linenumber, i, v, lag(v) OVER (PARTITION BY l_linenumber ORDER BY i) AS b FROM (SELECT l_linenumber, l_suppkey AS i, CASE l_linenumber % 3 WHEN 0 THEN l_suppkey WHEN 1 THEN -l_suppkey ELSE l_suppkey % 7 END AS v FROM (SELECT DISTINCT l_linenumber, l_suppkey FROM lineitem))) GROUP BY 1")
def detect_order(spark, d):
    """P19."""
    k, g = F.col("l_suppkey"), F.col("l_linenumber")
    axis = table(spark, d, "lineitem").select(g.alias("g"), k.alias("index")).distinct().withColumn("value", F.when(F.col("g") % 3 == 0, F.col("index")).when(F.col("g") % 3 == 1, -F.col("index")).otherwise(F.col("index") % 7))
    return clean.detect_order(axis, ["g"])


@query(f"WITH {CELLS} SELECT y, (SELECT max(x) FROM cells) - x AS x, value FROM cells", "value")
def flip_axis(spark, d):
    return clean.flip_axis(cells(spark, d).select("y", "x", "value"), "x")


VALID = GRID + ", q AS (SELECT date_trunc('month', time) AS stack, time, y, x, CASE WHEN y = 3 AND x = 3 AND month(time) = 2 THEN NULL ELSE t_c * CASE WHEN month(time) % 4 = 0 THEN 1.3 ELSE 0.2 END END AS value FROM grid), j AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY stack, y, x ORDER BY time)) AS j FROM q), s AS (SELECT stack, avg(CAST(value IS NULL AS DOUBLE)) AS bad_share, min(value) AS low, max(value) AS high, max(j) AS jump FROM j GROUP BY 1)"


@query(f"WITH {VALID} SELECT *, CASE WHEN bad_share >= 0.01 THEN 'rejected' WHEN bad_share > 0 THEN 'fixed_nans' WHEN low < -20 OR high > 60 THEN 'unusual_range' WHEN jump > 5 THEN 'large_temporal_jump' ELSE 'ok' END AS verdict FROM s", "bad_share low high jump")
def validate_range(spark, d):
    """P20."""
    month = F.month("time")
    v = F.when((F.col("y") == 3) & (F.col("x") == 3) & (month == 2), F.lit(None)).otherwise(F.col("t_c") * F.when(month % 4 == 0, 1.3).otherwise(0.2))
    return clean.validate_range(grid(spark, d).select(F.date_trunc("month", "time").alias("stack"), "time", "y", "x", v.alias("value")), ["stack"], jump=5)


RAISED = f"WITH {GRID}, d AS (SELECT time, y, x, CASE WHEN x < 3 THEN t_c ELSE t_c + 273.15 END + 250 AS v FROM grid) SELECT time, y, x, v - CASE WHEN (SELECT avg(v) FROM d) > 200 THEN 273.15 ELSE 0 END AS v FROM d"


@query(RAISED, "v")
def kelvin_guard(spark, d):
    """P2."""
    v = F.when(F.col("x") < 3, F.col("t_c")).otherwise(F.col("t_c") + 273.15) + 250
    return clean.kelvin_guard(grid(spark, d).select("time", "y", "x", v.alias("v")), "v")


PAIR = GRID + ", pp AS (SELECT pair_id, t1, t2 FROM (SELECT row_number() OVER (ORDER BY time) AS pair_id, time AS t1, lead(time) OVER (ORDER BY time) AS t2 FROM (SELECT DISTINCT time FROM grid)) WHERE t2 IS NOT NULL), fr AS (SELECT 'a' AS model, time, y, x, t_c AS value FROM grid)"


def steps(spark, d):
    """Frames, and all pairs of one time and the next."""
    g = grid(spark, d)
    w = Window.orderBy("time")
    pairs = g.select("time").distinct().select(F.row_number().over(w).cast("bigint").alias("pair_id"), F.col("time").alias("t1"), F.lead("time").over(w).alias("t2")).where("t2 is not null")
    return g.select(F.lit("a").alias("model"), "time", "y", "x", F.col("t_c").alias("value")), pairs


@query(f"WITH {PAIR} SELECT a.model, pair_id, avg(b.value - a.value) AS mean, quantile_cont(b.value - a.value, 0.1) AS p10, quantile_cont(b.value - a.value, 0.9) AS p90, min(b.value - a.value) AS min, max(b.value - a.value) AS max FROM fr a JOIN pp ON pp.t1 = a.time JOIN fr b ON b.time = pp.t2 AND b.y = a.y AND b.x = a.x GROUP BY 1, 2", "mean p10 p90 min max")
def cooling_by_pair(spark, d):
    """A29."""
    return sampling.cooling_by_pair(*steps(spark, d))


@query(f"WITH {PAIR}, dl AS (SELECT a.model, pair_id, a.y, a.x, b.value - a.value AS d FROM fr a JOIN pp ON pp.t1 = a.time JOIN fr b ON b.time = pp.t2 AND b.y = a.y AND b.x = a.x), m AS (SELECT model, avg(d) AS d FROM dl GROUP BY model, y, x) SELECT model, (SELECT count(DISTINCT pair_id) FROM dl) AS n_pairs, avg(d) AS mean_delta_t, quantile_cont(d, 0.1) AS p10_delta_t, quantile_cont(d, 0.9) AS p90_delta_t FROM m GROUP BY 1", "mean_delta_t p10_delta_t p90_delta_t")
def cooling_summary(spark, d):
    """A29, on the mean map."""
    return sampling.cooling_summary(*steps(spark, d))


@query(f"WITH {GRID}, c AS (SELECT y, x, sum(CASE WHEN t_c > 40 THEN 1 ELSE 0 END) AS n FROM grid GROUP BY 1, 2) SELECT 'a' AS model, 100 * avg(CAST(n >= 3 AS DOUBLE)) AS pct_persistent FROM c", "pct_persistent")
def persistence(spark, d):
    return sampling.persistence(grid(spark, d).select(F.lit("a").alias("model"), "y", "x", F.col("t_c").alias("value")), 40.0)


TRIALS = GRID + ", tr AS (SELECT l_returnflag AS model, l_linenumber AS trial, date_trunc('month', l_shipdate) AS time, CAST(l_suppkey // 10 AS INT) AS y, CAST(l_suppkey % 10 AS INT) AS x, avg(l_quantity) AS value FROM lineitem GROUP BY ALL), cl AS (SELECT date_trunc('month', l_shipdate) AS time, CAST(l_suppkey // 10 AS INT) AS y, CAST(l_suppkey % 10 AS INT) AS x, avg(l_quantity) AS clean, avg(l_quantity * (1 + l_tax)) AS hr FROM lineitem GROUP BY ALL), ce AS (SELECT model, time, y, x, max(value) - min(value) AS range, stddev_pop(value) AS std, avg(value) AS mean FROM tr GROUP BY ALL)"


@query(
    f"""WITH {TRIALS} SELECT model, time, max(range) AS max_range, avg(std) AS mean_std, quantile_cont(range, 0.95) AS p95_range, avg(abs(mean - clean)) AS mean_abs_dev, sqrt(avg((mean - clean) * (mean - clean))) AS rmse_vs_clean,
avg(abs(clean - hr)) AS mae_clean_vs_hr, sqrt(avg((clean - hr) * (clean - hr))) AS rmse_clean_vs_hr FROM ce JOIN cl USING (time, y, x) GROUP BY 1, 2""",
    "max_range mean_std p95_range mean_abs_dev rmse_vs_clean mae_clean_vs_hr rmse_clean_vs_hr",
)
def robustness_summary(spark, d):
    """A28."""
    k = F.col("l_suppkey")
    rows = table(spark, d, "lineitem").withColumns({"time": F.date_trunc("month", F.col("l_shipdate").cast("timestamp")), "y": F.floor(k / 10).cast("int"), "x": (k % 10).cast("int")})
    trials = rows.groupBy(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("trial"), "time", "y", "x").agg(F.avg("l_quantity").alias("value"))
    clean_ = rows.groupBy("time", "y", "x").agg(F.avg("l_quantity").alias("clean"), F.avg(F.col("l_quantity") * (1 + F.col("l_tax"))).alias("hr"))
    return sampling.robustness_summary(trials, clean_, ["model", "time"])


HOUR_RES = """hr AS (SELECT CAST(l_linenumber * 7 % 24 AS INT) AS l, CASE l_linenumber WHEN 1 THEN 3 WHEN 2 THEN 14 ELSE l_linenumber END AS hour, CAST(l_suppkey AS INT) AS y, CAST(l_quantity % 3 AS INT) AS x,
  l_quantity AS pred_c, l_quantity * (1 + l_tax - l_discount) AS t_c, l_extendedprice AS feature FROM lineitem)"""
HOUR_FIGURES = """c AS (SELECT hour, y, x, avg(abs(pred_c - t_c)) AS e, avg(feature) AS f FROM hr GROUP BY hour, y, x),
q AS (SELECT hour, CASE WHEN count(*) >= 10 THEN regr_r2(e, f) END AS r2 FROM c GROUP BY hour),
h AS (SELECT hour, avg(abs(pred_c - t_c)) AS mae, avg(pred_c) AS pred_mean, avg(t_c) AS ref_mean FROM hr WHERE hour IN (3, 14) GROUP BY hour)"""


def hour_rows(spark, d):
    k, q = F.col("l_linenumber"), F.col("l_quantity")
    hour = F.when(k == 1, 3).when(k == 2, 14).otherwise(k.cast("int"))
    cell = [F.col("l_suppkey").cast("int").alias("y"), (q % 3).cast("int").alias("x")]
    return table(spark, d, "lineitem").select(hour.alias("hour"), *cell, q.alias("pred_c"), (q * (1 + F.col("l_tax") - F.col("l_discount"))).alias("t_c"), F.col("l_extendedprice").alias("feature"))


@query(f"WITH {HOUR_RES}, {HOUR_FIGURES} SELECT hour, mae, pred_mean, ref_mean, r2 FROM h JOIN q USING (hour)", "mae pred_mean ref_mean r2")
def hour_residuals(spark, d):
    """A31, hours 3 and 14."""
    return grids.hour_residuals(hour_rows(spark, d)).drop("bias")


@query(f"WITH {HOUR_RES} SELECT avg(pred_c - t_c) AS bias, avg(abs(pred_c - t_c)) AS mae, sqrt(avg((pred_c - t_c) * (pred_c - t_c))) AS rmse FROM hr", "bias mae rmse")
def overall_residuals(spark, d):
    """A31, all hours."""
    return grids.overall_residuals(hour_rows(spark, d))


@query(
    f"""WITH {HOUR_RES}, {HOUR_FIGURES}, b AS (SELECT hour, avg(pred_c - t_c) AS bias FROM hr GROUP BY hour), f AS (SELECT * FROM h JOIN b USING (hour) JOIN q USING (hour))
SELECT n.mae - d.mae AS delta_mae, n.bias - d.bias AS delta_bias, n.pred_mean - d.pred_mean AS delta_pred_mean, n.ref_mean - d.ref_mean AS delta_ref_mean, n.r2 - d.r2 AS delta_r2
FROM f AS n, f AS d WHERE n.hour = 3 AND d.hour = 14""",
    "delta_mae delta_bias delta_pred_mean delta_ref_mean delta_r2",
)
def day_night_delta(spark, d):
    """A31, the night's figures less the day's."""
    return grids.day_night_delta(grids.hour_residuals(hour_rows(spark, d)))


# Of all triangles of points around a target, the Delaunay triangle has the least weighted sum of squared distances.
LINEAR = """pt AS (SELECT s_suppkey AS k, 2 + (s_suppkey * 104729 % 997) / 997.0::DOUBLE AS x, 41 + (s_suppkey * 7919 % 1009) / 1009.0::DOUBLE AS y, CAST(s_acctbal AS DOUBLE) AS v FROM supplier),
tg AS (SELECT DISTINCT p_size AS n, 1.95 + (p_size * 17 % 50) / 50.0::DOUBLE * 1.1 AS x, 40.95 + p_size / 50.0::DOUBLE * 1.1 AS y FROM part),
tr AS (SELECT a.x AS ax, a.y AS ay, a.v AS av, b.x AS bx, b.y AS byy, b.v AS bv, c.x AS cx, c.y AS cy, c.v AS cv FROM pt AS a JOIN pt AS b ON b.k > a.k JOIN pt AS c ON c.k > b.k),
de AS (SELECT *, (bx - ax) * (cy - ay) - (cx - ax) * (byy - ay) AS den FROM tr),
w1 AS (SELECT tg.n, tg.x, tg.y, de.*, ((tg.x - ax) * (cy - ay) - (cx - ax) * (tg.y - ay)) / den AS b, ((bx - ax) * (tg.y - ay) - (tg.x - ax) * (byy - ay)) / den AS c FROM de, tg WHERE den <> 0),
w2 AS (SELECT *, 1 - b - c AS a FROM w1 WHERE b >= 0 AND c >= 0 AND b + c <= 1),
inn AS (SELECT n, arg_min(a * av + b * bv + c * cv, a * ((ax - x) ** 2 + (ay - y) ** 2) + b * ((bx - x) ** 2 + (byy - y) ** 2) + c * ((cx - x) ** 2 + (cy - y) ** 2)) AS v FROM w2 GROUP BY n),
nea AS (SELECT tg.n, arg_min(pt.v, (tg.x - pt.x) ** 2 + (tg.y - pt.y) ** 2) AS v FROM tg, pt GROUP BY tg.n)"""


@query(f"WITH {LINEAR} SELECT CAST(nea.n AS INT) AS y, 0 AS x, coalesce(inn.v, nea.v) AS v FROM nea LEFT JOIN inn USING (n)", "v", 2)
def points_to_grid_linear(spark, d):
    """G1, linear in the triangles of scattered points, the nearest point outside."""
    k, n = F.col("s_suppkey"), F.col("p_size")
    points = table(spark, d, "supplier").select((41 + k * 7919 % 1009 / 1009.0).alias("lat"), (2 + k * 104729 % 997 / 997.0).alias("lon"), F.col("s_acctbal").cast("double").alias("v"))
    cells = table(spark, d, "part").select(n.cast("int").alias("y"), F.lit(0).alias("x"), (40.95 + n / 50.0 * 1.1).alias("lat"), (1.95 + n * 17 % 50 / 50.0 * 1.1).alias("lon")).distinct()
    return scattered.interpolate_linear(points, cells, ["v"])


@query("SELECT p_partkey AS k, CAST(CAST(p_partkey % 90 AS VARCHAR) AS DOUBLE) AS lat, TRY_CAST(CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE CAST(p_size AS VARCHAR) END AS DOUBLE) AS lon FROM part")
def parse_index(spark, d):
    """P15."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(k.alias("k"), F.concat_ws("_", (k % 90).cast("string"), F.when(k % 5 == 0, "x").otherwise(F.col("p_size").cast("string"))).alias("index"))
    lat, lon = C.parse_index(F.col("index"))
    return rows.select("k", lat.alias("lat"), lon.alias("lon"))
