"""Column functions: units, classes, names, times."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import stored

# Fixed values: (scale, offset) that take the first unit to the second.
UNITS = {
    ("degC", "K"): (1.0, 273.15), ("K", "degC"): (1.0, -273.15), ("hPa", "Pa"): (100.0, 0.0), ("m/h", "mm/s"): (1000.0 / 3600.0, 0.0), ("mm/h", "mm/s"): (1.0 / 3600.0, 0.0),
    ("kt", "m/s"): (0.514444, 0.0), ("mm/s", "mm/d"): (86400.0, 0.0), ("kg m-2 s-1", "mm/s"): (1.0, 0.0), ("cfs", "m3/s"): (0.028316846592, 0.0), ("in", "mm"): (25.4, 0.0),
}
NULL_TOKENS = ["", " ", "NA", "na", "N/A", "n/a", "NULL", "null", "-", "--", "---", "missing", "Missing", "MISSING"]
# Plausible ranges of forcing variables.
RANGES = {"airtemp": (200.0, 350.0), "airpres": (5e4, 1.1e5), "spechum": (0.0, 0.1), "windspd": (0.0, 100.0), "pptrate": (0.0, 0.1), "LWRadAtm": (50.0, 600.0), "SWRadAtm": (0.0, 1500.0)}
# Texture classes as least and greatest percent of sand, silt and clay; the boxes overlap, the first match wins.
TEXTURES = [
    ("clay", 0, 45, 0, 40, 40, 100),
    ("silty_clay", 0, 20, 40, 60, 40, 60),
    ("sandy_clay", 45, 65, 0, 20, 35, 55),
    ("clay_loam", 20, 45, 15, 53, 27, 40),
    ("silty_clay_loam", 0, 20, 40, 73, 27, 40),
    ("sandy_clay_loam", 45, 80, 0, 28, 20, 35),
    ("loam", 23, 52, 28, 50, 7, 27),
    ("silty_loam", 0, 50, 50, 88, 0, 27),
    ("sandy_loam", 50, 80, 0, 50, 0, 20),
    ("silt", 0, 20, 80, 100, 0, 12),
    ("loamy_sand", 70, 90, 0, 30, 0, 15),
    ("sand", 85, 100, 0, 15, 0, 10),
]


def convert_units(c: Column, source: str, target: str) -> Column:
    if source == target:
        return c
    scale, offset = UNITS[source, target]
    return c * scale + offset


def mmday_to_cms(q: Column, area_km2: Column) -> Column:
    return q * area_km2 / 86.4


def cms_to_mmday(q: Column, area_km2: Column) -> Column:
    return q * 86.4 / area_km2


def standardise(df: DataFrame, names: dict[str, tuple[str, str, str]]) -> DataFrame:
    """names: wanted column to (column there, its unit, wanted unit); a column that is missing is an error."""
    lack = [n for n, (c, _, _) in names.items() if c not in df.columns]
    if lack:
        raise ValueError(f"no column for {', '.join(lack)}")
    rest = [c for c in df.columns if c not in {v[0] for v in names.values()}]
    return df.select(*rest, *[convert_units(F.col(c), a, b).alias(n) for n, (c, a, b) in names.items()])


def detect_temperature_unit(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """K where the mean is above 100, degC from -100 to 60, else null."""
    m = F.avg(col)
    return df.groupBy(*keys).agg(F.when(m > 100, "K").when(m.between(-100, 60), "degC").alias("unit"))


def detect_storage_scale(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    r = F.max(col) - F.min(col)
    return df.groupBy(*keys).agg(F.when(r > 1000, 0.1).when(r > 10, 10.0).otherwise(1.0).alias("scale"))


def infer_scale(pairs: DataFrame, keys: list[str], candidates: dict[str, float]) -> DataFrame:
    """The unit whose factor on sim gives the least RMSE: all candidates in one aggregate."""
    e = [F.struct(F.sqrt(F.avg((F.col("sim") * f - F.col("obs")) ** 2)).alias("rmse"), F.lit(n).alias("unit")) for n, f in candidates.items()]
    return pairs.groupBy(*keys).agg(F.array_min(F.array(*e)).alias("_b")).select(*keys, F.col("_b.unit").alias("unit"), F.col("_b.rmse").alias("rmse"))


def clean_numeric(c: Column, least: float | None = None) -> Column:
    v = F.when(~F.trim(c).isin([t.strip() for t in NULL_TOKENS]), F.trim(c)).try_cast("double")
    return v if least is None else F.when(v >= least, v)


def clip_ranges(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Values moved to the nearer bound; nulls stay null."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(float(a))), F.lit(float(b)))) for c, (a, b) in ranges.items()})


def range_counts(df: DataFrame, keys: list[str], ranges: dict[str, tuple[float, float]]) -> DataFrame:
    return df.groupBy(*keys).agg(*[x for c, (a, b) in ranges.items() for x in (F.count_if(F.col(c) < a).alias(f"{c}_below"), F.count_if(F.col(c) > b).alias(f"{c}_above"))])


def validate(df: DataFrame, keys: list[str], temperature: str | None = None, flow: str | None = None, precipitation: str | None = None) -> DataFrame:
    """Missing values of every column and implausible ones of those named."""
    out = [F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"{c}_missing") for c in df.columns if c not in keys]]
    if temperature:
        out.append(F.count_if(~F.col(temperature).between(200, 330)).alias("temperature_bad"))
    if flow:
        out.append(F.count_if(F.col(flow) < 0).alias("flow_negative"))
    if precipitation:
        out += [F.count_if(F.col(precipitation) < 0).alias("precipitation_negative"), F.count_if(F.col(precipitation) > 1000).alias("precipitation_large")]
    return df.groupBy(*keys).agg(*out)


FORMATS = ["dd/MM/yyyy", "MM/dd/yyyy", "yyyy-MM-dd", "dd-MM-yyyy", "MM-dd-yyyy"]


def parse_ts(df: DataFrame, col: str, formats: list[str] = FORMATS, least: float = 0.8) -> DataFrame:
    """The column read by the first format that fits more than `least` of its values, all tried in one pass."""
    ok = df.agg(*[F.avg(F.try_to_timestamp(col, F.lit(f)).isNotNull().cast("double")).alias(str(i)) for i, f in enumerate(formats)]).first()
    for i, f in enumerate(formats):
        if (ok[i] or 0) > least:
            return df.withColumn(col, F.try_to_timestamp(col, F.lit(f)).cast("timestamp_ntz"))
    raise ValueError(f"no format fits {col}")


def round_hour(ts: Column) -> Column:
    """The nearest hour; an exact half goes to the even hour."""
    low = F.date_trunc("hour", ts)
    up = F.date_trunc("hour", ts + F.expr("INTERVAL 30 MINUTES"))
    half = ts == low + F.expr("INTERVAL 30 MINUTES")
    return F.when(half & (F.hour(low) % 2 == 0), low).otherwise(up)


def decode_time(n: Column, unit: str, reference: str) -> Column:
    """Numbers of s, h or D since a reference time."""
    seconds = {"s": 1, "h": 3600, "D": 86400}[unit]
    return F.lit(reference).cast("timestamp_ntz") + F.make_dt_interval(secs=F.round(n * seconds))


def encode_time(ts: Column, reference: str = "1990-01-01") -> Column:
    return F.unix_timestamp(ts.cast("timestamp")) - F.unix_timestamp(F.lit(reference).cast("timestamp"))


def clean_name(c: Column) -> Column:
    """Lower case; blanks - . / \\ to _; brackets and commas out; & and % spelt out; 50 characters at most; empty is unknown."""
    x = F.translate(F.lower(c), " -./\\(),", "_____")
    x = F.replace(F.replace(x, F.lit("&"), F.lit("and")), F.lit("%"), F.lit("percent"))
    x = F.regexp_replace(x, "[^a-z0-9_]", "")
    x = F.when(x.rlike("^[0-9]"), F.concat(F.lit("x"), x)).otherwise(x)
    x = F.substring(x, 1, 50)
    return F.when(x == "", "unknown").otherwise(F.coalesce(x, F.lit("unknown")))


def classify_keywords(c: Column, classes: dict[str, list[str]], other: str | None = None) -> Column:
    """The first class, in order, one of whose keywords is in the lower-cased text."""
    out, low = None, F.lower(c)
    for name, words in classes.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)


def classify_bins(c: Column, edges: list[float], labels: list[str]) -> Column:
    """labels[i] below edges[i], the last label from the last edge on."""
    out = F.when(c < edges[0], labels[0])
    for e, n in zip(edges[1:], labels[1:], strict=False):
        out = out.when(c < e, n)
    return out.when(c.isNotNull(), labels[-1])


def usda_texture(sand: Column, silt: Column, clay: Column) -> Column:
    total = sand + silt + clay
    s, i, c = 100 * sand / total, 100 * silt / total, 100 * clay / total
    out = F.when(total.isNull() | (total <= 0), F.lit(None))
    for n, a, b, d, e, f, g in TEXTURES:
        out = out.when(s.between(a, b) & i.between(d, e) & c.between(f, g), n)
    return out


def aspect_class(deg: Column, n: int = 8, flat: Column | None = None) -> Column:
    """Sector 1..n of a compass direction, north centred on 0; 0 where flat or unknown."""
    k = F.floor(F.pmod(deg + 180.0 / n, F.lit(360.0)) / (360.0 / n)).cast("int") + 1
    return F.when(deg.isNull() | (flat if flat is not None else F.lit(False)), 0).otherwise(k)


def hydrogeology(logk: Column, porosity: Column) -> dict[str, Column]:
    """Conductivity (m/s, cm/h, m/d), transmissivity at 10 and 100 m, specific yield, diffusivity and response time (d)."""
    k = F.pow(F.lit(10.0), logk) * 1e7
    d = k / 1e-4
    return {"k_ms": k, "k_cmh": k * 100 * 3600, "k_md": k * 86400, "t10": k * 10, "t100": k * 100, "sy": 0.2 * porosity, "diffusivity": d, "response_days": 1e6 / (d * 86400)}


def depth_weighted(layers: list[Column], thickness: tuple[int, ...] = (5, 10, 15, 30, 40, 100)) -> Column:
    """Mean over the layers by thickness; a missing layer adds nothing and the divisor stays the full depth."""
    return sum((F.coalesce(c, F.lit(0.0)) * t for c, t in zip(layers, thickness, strict=True)), F.lit(0.0)) / sum(thickness)


# Fixed values of the pedotransfer functions: constant, then factors of sand, clay and silt.
POROSITY = (0.46, 0.0, -0.0026, 0.0)
FIELD_CAPACITY = (0.2576, -0.002, 0.0036, 0.0299)
WILTING_POINT = (0.026, 0.0, 0.005, 0.0158)


def soil_hydraulics(sand: list[Column], clay: list[Column], silt: list[Column]) -> dict[str, Column]:
    """Depth-weighted texture, and from it porosity, field capacity, wilting point, available water and conductivity (mm/h)."""
    mean = [depth_weighted(layers) for layers in (sand, clay, silt)]
    linear = lambda k: sum((m * f for m, f in zip(mean, k[1:], strict=True)), F.lit(k[0]))
    porosity, capacity, wilting = linear(POROSITY), linear(FIELD_CAPACITY), linear(WILTING_POINT)
    ksat = 10 * 2.54 * 2.778e-6 * F.pow(F.lit(10.0), 3.0 * porosity - 8.5)
    return {"sand": mean[0], "clay": mean[1], "silt": mean[2], "porosity": porosity, "field_capacity": capacity, "wilting_point": wilting, "available_water": capacity - wilting, "ksat": ksat}


def qc_filter(df: DataFrame, flag: str, op: str, limit: float) -> DataFrame:
    """Rows whose quality flag is at most (<=) or at least (>=) the limit; a null flag drops the row."""
    if op not in ("<=", ">="):
        raise ValueError(f"no such comparison: {op}")
    return df.where(F.col(flag) <= limit if op == "<=" else F.col(flag) >= limit)


def apply_scale(c: Column, scale: float = 1.0, offset: float = 0.0, nodata: float | None = None, default: float | None = None) -> Column:
    v = F.nullif(c, F.lit(nodata)) if nodata is not None else c
    v = v * scale + offset
    return v if default is None else F.coalesce(v, F.lit(default))


def dedup(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def renumber(df: DataFrame, order: list[str], name: str = "new_id") -> DataFrame:
    """1..n in a global order: a range-partitioned sort, then each partition's offset from a small table of counts.

    The sorted frame is written, so that counts and rows are of the same partitions.
    """
    d = stored(df.sort(*order).withColumn("_p", F.spark_partition_id()))
    d = d.withColumn("_i", F.row_number().over(W.partitionBy("_p").orderBy(*order)))
    n = d.groupBy("_p").agg(F.count("*").alias("_n"))
    start = n.select("_p", (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_s"))
    return d.join(F.broadcast(start), "_p").withColumn(name, F.col("_i") + F.col("_s")).drop("_p", "_i", "_s")


def clean_fractions(df: DataFrame, keys: list[str], cls: str, frac: str, least: float = 0.01) -> DataFrame:
    """Shares below `least` become 0 and the rest sum to 1 again (long form: one row a unit and class)."""
    v = F.when(F.col(frac) < least, 0.0).otherwise(F.col(frac))
    d = df.withColumn(frac, v)
    total = F.sum(frac).over(W.partitionBy(*keys))
    return d.withColumn(frac, F.when(total > 0, F.col(frac) / total).otherwise(F.col(frac)))


def complete_fractions(df: DataFrame, key: str, cls: str, frac: str, classes: int = 20, least: float = 0.01, tiny: float = 1e-5) -> DataFrame:
    """(key, cls, frac) with a row for each of the classes 1..n: shares cleaned as `clean_fractions` does, missing ones 0, and those of the
    unit of lowest key `tiny` at least, so that every class occurs somewhere."""
    have = clean_fractions(df.select(key, cls, frac), [key], cls, frac, least)
    every = df.select(key).distinct().withColumn(cls, F.explode(F.sequence(F.lit(1), F.lit(classes))))
    d = every.join(have.withColumn(cls, F.col(cls).cast("int")), [key, cls], "left").crossJoin(F.broadcast(df.agg(F.min(key).alias("_first"))))
    v = F.coalesce(F.col(frac).cast("double"), F.lit(0.0))
    return d.select(key, cls, F.when(F.col(key) == F.col("_first"), F.greatest(v, F.lit(tiny))).otherwise(v).alias(frac))


def fill_majority(df: DataFrame, col: str, unify: bool = False) -> DataFrame:
    """Classes null or 0 become the most frequent class of all rows (ties to the lowest); with `unify` every class does. Without any other class they stay."""
    best = df.where(F.col(col) != 0).groupBy(F.col(col).alias("_c")).agg(F.count("*").alias("_n")).agg((-F.max(F.struct("_n", (-F.col("_c")).alias("k")))["k"]).alias("_best"))
    known = F.lit(False) if unify else F.coalesce(F.col(col) != 0, F.lit(False))
    return df.crossJoin(F.broadcast(best)).withColumn(col, F.when(known, F.col(col)).otherwise(F.coalesce("_best", F.col(col)))).drop("_best")


def normalise(c: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c - low) / (high - low)))


def denormalise(c: Column, low: Column, high: Column) -> Column:
    return low + c * (high - low)


def bbox_filter(df: DataFrame, north: float, west: float, south: float, east: float, lat: str = "lat", lon: str = "lon", smallest: float = 0.1) -> DataFrame:
    """Rows in a box; a box thinner than `smallest` grows to it about its centre; west > east crosses the antimeridian."""
    def grow(a: float, b: float) -> tuple[float, float]:
        return (a, b) if b - a >= smallest else ((a + b - smallest) / 2, (a + b + smallest) / 2)

    south, north = grow(south, north)
    x = F.col(lon)
    if west <= east:
        west, east = grow(west, east)
        side = x.between(west, east)
    else:
        side = (x >= west) | (x <= east)
    return df.where(F.col(lat).between(south, north) & side)


def bbox_mean(df: DataFrame, by: list[str], cols: list[str], north: float, west: float, south: float, east: float, lat: str = "lat", lon: str = "lon", smallest: float = 0.1, expand: float = 0.2) -> DataFrame:
    """Rows in a box as `bbox_filter` finds them; of a box thinner than `smallest` on a side the mean of `cols` for each `by`, one point with the mean position.

    Where such a box holds no row, it is first grown by `expand` on all sides.
    """
    d = bbox_filter(df, north, west, south, east, lat, lon, smallest)
    if north - south >= smallest and (west > east or east - west >= smallest):
        return d.select(*by, lat, lon, *cols)
    if d.isEmpty():
        d = bbox_filter(df, north + expand, west - expand, south - expand, east + expand, lat, lon, smallest)
    return d.groupBy(*by).agg(*[F.avg(c).alias(c) for c in (lat, lon, *cols)])


def drop_spinup(df: DataFrame, keys: list[str], d: str, rule: str, value: float | str | None = None) -> DataFrame:
    """first_year: the first calendar year; percent: that share of the days from first to last; until: up to a date;
    one_year: the first year of record."""
    w = W.partitionBy(*keys)
    first, last, c = F.min(d).over(w), F.max(d).over(w), F.col(d)
    keep = {
        "first_year": lambda: F.year(c) > F.year(first), "percent": lambda: F.datediff(c, first) >= F.floor(F.datediff(last, first) * float(value) / 100),
        "until": lambda: c > F.lit(value).cast("date"), "one_year": lambda: c >= F.add_months(first, 12),
    }[rule]()
    return df.withColumn("_k", keep).where("_k").drop("_k")


def slope_class(c: Column) -> Column:
    return classify_bins(c, [math.radians(x) for x in (2, 5, 10, 20)], ["flat", "gentle", "moderate", "steep", "very steep"])
