"""Scalar column expressions: time, units, wind, text, alert levels, urban form and map coordinates."""

from __future__ import annotations

import math
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Alert levels in rising order, and the fractions from which they hold.
LEVELS = ("normal", "watch", "warning", "severe")
LEVEL_FROM = {"watch": 0.05, "warning": 0.10, "severe": 0.25}
# Names of models that stand for others.
MODEL_ALIASES = {"convlstm": "lstm"}
# Urban form.
BUFFER_M, MIN_STREET_M, OPEN_LOW, OPEN_HIGH = 150.0, 6.0, 0.02, 0.25
METRES_PER_DEGREE = 111_320.0


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def corr(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation of the pairs without nulls; null without variance (Spark's own divides by zero there)."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    both = a.isNotNull() & b.isNotNull()
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b)))


def exact_mean(c: Column) -> Column:
    """Mean of doubles whose sum doesn't depend on the rows' order: whole parts and 60 bits behind the point are summed as whole numbers, and rounded once.

    Null for no value. Values of 2^31 or more are summed as doubles; NaN stays NaN.
    """
    c = c.cast("double")
    small = F.abs(c) < 2**31
    whole = F.floor(F.when(small, c))
    rest = (c - whole) * 2**30
    high = F.floor(rest)
    low = F.floor((rest - high) * 2**30)
    total = ((F.sum(whole).cast("decimal(20)") * 2**30 + F.sum(high)) * 2**30 + F.sum(low)).cast("double") / 2**60
    return F.try_divide(F.coalesce(total, F.lit(0.0)) + F.coalesce(F.sum(F.when(~small, c)), F.lit(0.0)), F.count(c))


def clip(c: Column, low: float, high: float) -> Column:
    """c within [low, high]; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def floor_hour(c: Column) -> Column:
    return F.date_trunc("hour", c)


def hour_in_window(c: Column, first: int, last: int) -> Column:
    """True for hours from first to last, both included; the window wraps midnight if first > last."""
    hour = F.hour(c)
    return hour.between(first, last) if first <= last else (hour >= first) | (hour <= last)


def label_model(c: Column) -> Column:
    """Lower-case model name; aliases are resolved."""
    name = F.lower(F.trim(c))
    known = F.create_map(*[F.lit(x) for kv in MODEL_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, name), name)


def extract_seed(c: Column) -> Column:
    """The number after _S in a run's name; null without one."""
    return F.when(c.rlike(r"_S\d+"), F.regexp_extract(c, r"_S(\d+)", 1).cast("int"))


def label_variant(experiment: Column, seq_len: Column) -> Column:
    """experiment with its sequence length, as <name>_T<len>; the bare name without a length."""
    return F.when(seq_len.isNull(), experiment).otherwise(F.concat(experiment, F.lit("_T"), seq_len.cast("string")))


def kelvin_to_celsius(c: Column) -> Column:
    return c - 273.15


def millimetres_to_metres(c: Column) -> Column:
    return c / 1000


def watts_to_joules_per_hour(c: Column) -> Column:
    return c * 3600


def wind_components(speed: Column, direction: Column) -> tuple[Column, Column]:
    """u and v of a wind that comes from `direction` degrees."""
    return -speed * F.sin(F.radians(direction)), -speed * F.cos(F.radians(direction))


def parse_index(c: Column) -> tuple[Column, Column]:
    """Latitude and longitude of "<lat>_<lon>"; null where a part is no number."""
    part = lambda k: F.split_part(c, F.lit("_"), F.lit(k)).try_cast("double")
    return part(1), part(2)


def alert_level(fraction: Column, starts: dict[str, float] | None = None) -> Column:
    """Highest level whose fraction is reached; null counts as normal."""
    out = F.lit(LEVELS[0])
    for level in LEVELS[1:]:
        out = F.when(fraction >= (starts or LEVEL_FROM)[level], level).otherwise(out)
    return out


def level_rank(level: Column) -> Column:
    """0 for normal to 3 for severe; unknown names are 0."""
    out = F.lit(0)
    for k, name in enumerate(LEVELS):
        out = F.when(level == name, k).otherwise(out)
    return out


def parse_name_time(name: Column) -> Column:
    """Timestamp YYYY MM DD HH MM [SS] in a file name, parts joined by - _ T or :; null without one."""
    sep = "[-_T:]"
    pattern = rf"(\d{{4}}){sep}(\d{{2}}){sep}(\d{{2}}){sep}(\d{{2}}){sep}(\d{{2}})(?:{sep}(\d{{2}}))?"
    part = lambda k: F.regexp_extract(name, pattern, k)
    seconds = F.when(part(6) == "", "00").otherwise(part(6))
    text = F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit(" "), part(4), F.lit(":"), part(5), F.lit(":"), seconds)
    return F.when(part(1) != "", F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))


def season_id(c: Column) -> Column:
    """0 for December to February, then 1 to 3 for each three months."""
    return (F.month(c) % 12 / 3).cast("int")


def fourier(hour: Column, month: Column, n: int = 4) -> dict[str, Column]:
    """n sine and cosine pairs of the hour (period 24) and of the month (period 12)."""
    out: dict[str, Column] = {}
    for name, value, period in (("hour", hour, 24), ("month", month, 12)):
        for k in range(1, n + 1):
            angle = value * (2 * math.pi * k / period)
            out |= {f"{name}_sin{k}": F.sin(angle), f"{name}_cos{k}": F.cos(angle)}
    return out


def place_norms(lat: Column, lon: Column) -> tuple[Column, Column]:
    return (lat - 41.2) / 0.4, (lon - 1.9) / 0.5


# The raw columns that each composite index is the mean of.
COMPOSITES = {
    "residential_index": ("building_area_residential", "n_dwellings"),
    "industrial_index": ("building_area_industrial", "building_area_warehouse_parking"),
    "services_index": ("building_area_offices", "building_area_commercial", "building_area_healthcare_and_charity", "building_area_religious", "building_area_cultural"),
    "leisure_index": ("building_area_sports_facilities", "building_area_entertainment_venues", "building_area_leisure_and_hospitality", "building_area_singular_building"),
    "height_index": ("n_floors_above_ground",),
}


def composite_indices(df: DataFrame) -> DataFrame:
    """Adds the composite indices from their *_percentile columns; a table that has them all passes unchanged."""
    if set(COMPOSITES) <= set(df.columns):
        return df
    missing = [f"{c}_percentile" for parts in COMPOSITES.values() for c in parts if f"{c}_percentile" not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    return df.withColumns({name: sum((F.col(f"{c}_percentile") for c in parts[1:]), F.col(f"{parts[0]}_percentile")) / len(parts) for name, parts in COMPOSITES.items()})


def _canyon(density: Column, height: Column, width: Column) -> dict[str, Column]:
    ratio = F.when(width > 0, height / width).otherwise(0.0)
    canyon = clip(F.cos(F.atan(2 * ratio)), 0, 1)
    blend = clip((density - OPEN_LOW) / (OPEN_HIGH - OPEN_LOW), 0, 1)
    return {
        "building_density": density, "street_width_m": width, "h_over_w": ratio, "svf_canyon": canyon, "svf": clip(1 - blend + blend * canyon, 0, 1),
        "roughness": F.greatest(0.15 * height * (1 - F.exp(-F.sqrt(4 * density))), F.lit(0.001)),
    }


def _impervious(density: Column, ndvi: Column | None) -> Column:
    return density if ndvi is None else clip(0.65 * density + 0.35 * (1 - clip(ndvi, 0, 1)), 0, 1)


def morphology(built_m2: Column, height: Column, ndvi: Column | None = None, radius: float = BUFFER_M) -> dict[str, Column]:
    """Urban form of a disc from its built area and mean height."""
    density = clip(built_m2 / (math.pi * radius**2), 0, 1)
    width = clip(2 * radius * F.sqrt(clip(1 - density, 1e-4, 1)), MIN_STREET_M, 2 * radius)
    return _canyon(density, height, width) | {"impervious_fraction": _impervious(density, ndvi)}


def morphology_from_svf(height: Column, density: Column, svf: Column, ndvi: Column | None = None, radius: float = BUFFER_M) -> dict[str, Column]:
    """Street width and canyon ratio that a sky view factor stands for."""
    density, eps = clip(density, 0, 1), 1e-4
    ratio = 0.5 * F.tan(F.acos(clip(clip(svf, 0, 1), eps, 1 - eps)))
    return {
        "h_over_w": ratio, "street_width_m": clip(height / (ratio + eps), MIN_STREET_M, 2 * radius),
        "svf_canyon": clip(F.cos(F.atan(2 * ratio)), 0, 1), "impervious_fraction": _impervious(density, ndvi),
    }


def morphology_synthetic(height_index: Column, ndvi: Column, residential: Column, industrial: Column, services: Column, radius: float = BUFFER_M) -> dict[str, Column]:
    """Urban form from the composite indices alone."""
    density = clip(0.55 * clip(residential, 0, 1) + 0.25 * clip(services, 0, 1) + 0.20 * clip(industrial, 0, 1), 0, 1)
    height = 2.5 + 32 * clip(height_index, 0, 1)
    width = clip(2 * radius * F.sqrt(clip(1 - density, 1e-4, 1)), MIN_STREET_M, 2 * radius)
    form = _canyon(density, height, width)
    ratio = height / (width + 1e-4)
    canyon = clip(F.cos(F.atan(2 * ratio)), 0, 1)
    blend = clip((density - OPEN_LOW) / (OPEN_HIGH - OPEN_LOW), 0, 1)
    return form | {
        "avg_height": height, "max_levels": F.bround(height / 3), "h_over_w": ratio, "svf_canyon": canyon, "svf": clip(1 - blend + blend * canyon, 0, 1),
        "impervious_fraction": _impervious(density, ndvi), "buildings_in_buffer": F.bround(density * 220),
    }


def _plain(text: str | None) -> str | None:
    if text is None or text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def norm_text(c: Column) -> Column:
    """Lower-case, in compatibility form (NFKD) without combining marks, white space collapsed and trimmed; null stays null."""

    @F.pandas_udf("string")
    def plain(texts: pd.Series) -> pd.Series:
        return texts.map(_plain)

    return F.trim(F.regexp_replace(plain(F.lower(c)), r"(?U)\s+", " "))


def to_sorted_json(columns: list[str]) -> Column:
    """JSON of the columns with sorted keys; nulls are left out."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def local_metres(lat: Column, lon: Column, lat0: float) -> tuple[Column, Column]:
    """x and y in metres on a plane that touches latitude lat0."""
    return lon * (METRES_PER_DEGREE * math.cos(math.radians(lat0))), lat * METRES_PER_DEGREE


def laea_to_wgs84(x: Column, y: Column) -> tuple[Column, Column]:
    """Latitude and longitude of EPSG:3035 (Lambert azimuthal equal area on GRS80, centre 52 N 10 E)."""
    a, f = 6_378_137.0, 1 / 298.257222101
    e2 = f * (2 - f)
    e = math.sqrt(e2)
    lat0, lon0 = math.radians(52), math.radians(10)

    def q_of(lat: float) -> float:
        s = math.sin(lat)
        return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    qp = q_of(math.pi / 2)
    rq = a * math.sqrt(qp / 2)
    b0 = math.asin(q_of(lat0) / qp)
    d = a * math.cos(lat0) / (math.sqrt(1 - e2 * math.sin(lat0) ** 2) * rq * math.cos(b0))
    dx, dy = (x - 4_321_000) / d, (y - 3_210_000) * d
    rho = F.sqrt(dx * dx + dy * dy)
    c = 2 * F.asin(F.least(rho / (2 * rq), F.lit(1.0)))
    beta = F.when(rho == 0, b0).otherwise(F.asin(F.cos(c) * math.sin(b0) + dy * F.sin(c) * math.cos(b0) / rho))
    lon = lon0 + F.atan2(dx * F.sin(c), rho * math.cos(b0) * F.cos(c) - dy * math.sin(b0) * F.sin(c))
    lat = beta
    for k, factor in ((2, e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040), (4, 23 * e2**2 / 360 + 251 * e2**3 / 3780), (6, 761 * e2**3 / 45360)):
        lat = lat + factor * F.sin(k * beta)
    return F.degrees(lat), F.degrees(lon)
