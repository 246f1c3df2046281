"""Joins of cells and zones, zonal statistics, overlap weights and terrain, on boxes and cell tables."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import renumber
from ..scratch import stored


def _bins(low: Column, high: Column, size: float) -> Column:
    return F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))


def cells_in_zones(cells: DataFrame, zones: DataFrame, x: str = "x", y: str = "y", size: float = 8.0) -> DataFrame:
    """Cells with the zones whose box holds their centre (lower edges closed, upper open).

    Both sides are dealt into square bins and meet in an equi-join, so that a large cell table is neither
    broadcast nor compared with every zone; size: about a zone's width.
    """
    c = cells.withColumn("_bx", F.floor(F.col(x) / size)).withColumn("_by", F.floor(F.col(y) / size))
    z = zones.withColumn("_bx", _bins(F.col("xmin"), F.col("xmax"), size)).withColumn("_by", _bins(F.col("ymin"), F.col("ymax"), size))
    inside = (F.col(x) >= F.col("xmin")) & (F.col(x) < F.col("xmax")) & (F.col(y) >= F.col("ymin")) & (F.col(y) < F.col("ymax"))
    return c.join(z, ["_bx", "_by"]).where(inside).drop("_bx", "_by")


def cells_touching_zones(cells: DataFrame, zones: DataFrame, half: float = 0.5, size: float = 8.0) -> DataFrame:
    """Cells whose square of half-width `half` overlaps a zone's box; a pair that meets in several bins counts once."""
    c = cells.withColumn("_bx", _bins(F.col("x") - half, F.col("x") + half, size)).withColumn("_by", _bins(F.col("y") - half, F.col("y") + half, size))
    z = zones.withColumn("_bx", _bins(F.col("xmin"), F.col("xmax"), size)).withColumn("_by", _bins(F.col("ymin"), F.col("ymax"), size))
    hit = (F.col("x") + half > F.col("xmin")) & (F.col("x") - half < F.col("xmax")) & (F.col("y") + half > F.col("ymin")) & (F.col("y") - half < F.col("ymax"))
    # the pair's own bin is that of the overlap's lower corner
    own = (F.col("_bx") == F.floor(F.greatest(F.col("x") - half, F.col("xmin")) / size)) & (F.col("_by") == F.floor(F.greatest(F.col("y") - half, F.col("ymin")) / size))
    return c.join(z, ["_bx", "_by"]).where(hit & own).drop("_bx", "_by")


def zonal_stats(joined: DataFrame, keys: list[str], col: str, nodata: float | None = None) -> DataFrame:
    v = F.when(F.col(col) != nodata, F.col(col)) if nodata is not None else F.col(col)
    return joined.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.avg(v).alias("mean"), F.max(v).alias("hi"), F.stddev_pop(v).alias("std"), F.median(v).alias("median"))


def circ_stats(joined: DataFrame, keys: list[str], deg: str) -> DataFrame:
    """Circular mean in [0, 360) and circular standard deviation in degrees."""
    a = F.radians(F.col(deg))
    d = joined.where(F.col(deg).isNotNull()).groupBy(*keys).agg(F.avg(F.sin(a)).alias("_s"), F.avg(F.cos(a)).alias("_c"))
    r = F.least(F.lit(1.0), F.sqrt(F.col("_s") ** 2 + F.col("_c") ** 2))
    return d.select(*keys, F.pmod(F.degrees(F.atan2("_s", "_c")), F.lit(360.0)).alias("circ_mean"), F.degrees(F.sqrt(-2 * F.log(r))).alias("circ_std"))


def zonal_histogram(joined: DataFrame, keys: list[str], cls: str, classes: list[int], prefix: str) -> DataFrame:
    """One column a class with its count, 0 where missing, and the total."""
    return joined.groupBy(*keys).agg(*[F.count_if(F.col(cls) == k).alias(f"{prefix}{k}") for k in classes], F.count("*").alias("total"))


def majority_class(counts: DataFrame, keys: list[str], cls: str, n: str, rule: str) -> DataFrame:
    """Most frequent class, ties to the lowest. soil: 1..12, none is 6. land: 1..17, water (17) only if alone, none is 1."""
    top, none = (12, 6) if rule == "soil" else (17, 1)
    ok = F.col(cls).between(1, top)
    rank = F.struct(F.when(F.col(cls) == 17, 0).otherwise(1).alias("dry") if rule == "land" else F.lit(1).alias("dry"), F.col(n).alias("n"), (-F.col(cls)).alias("c"))
    if rule == "land":
        rank = F.struct(F.col(n).alias("n"), (-F.col(cls)).alias("c"))
        all_ = F.max(F.when(ok, rank))
        dry = F.max(F.when(ok & (F.col(cls) != 17), rank))
        best = F.when((-all_["c"] == 17) & dry.isNotNull(), -dry["c"]).otherwise(-all_["c"])
    else:
        best = -F.max(F.when(ok, rank))["c"]
    return counts.groupBy(*keys).agg(F.coalesce(best, F.lit(none)).cast("int").alias("majority"))


def class_fractions(joined: DataFrame, keys: list[str], cls: str, nodata: int | None = None) -> DataFrame:
    """Share of each class over valid cells, with the unit's dominant class and Shannon diversity."""
    d = joined.where(F.col(cls) != nodata) if nodata is not None else joined
    n = d.groupBy(*keys, cls).agg(F.count("*").alias("_n"))
    w = W.partitionBy(*keys)
    f = n.withColumn("fraction", F.col("_n") / F.sum("_n").over(w))
    f = f.withColumn("dominant", -F.max(F.struct("_n", (-F.col(cls)).alias("c"))).over(w)["c"]).withColumn("shannon", -F.sum(F.col("fraction") * F.log("fraction")).over(w))
    return f.drop("_n")


def group_fractions(joined: DataFrame, keys: list[str], cls: str, groups: dict[str, list[int]]) -> DataFrame:
    return joined.groupBy(*keys).agg(*[F.avg(F.col(cls).isin(v).cast("double")).alias(k) for k, v in groups.items()])


def irrigation(joined: DataFrame, keys: list[str], cls: str) -> DataFrame:
    """Cropland (1-3), irrigated (2-3) and their ratio."""
    d = group_fractions(joined, keys, cls, {"cropland": [1, 2, 3], "irrigated": [2, 3]})
    return d.withColumn("intensity", F.when(F.col("cropland") > 0, F.col("irrigated") / F.col("cropland")))


def diversity(joined: DataFrame, keys: list[str], cls: str) -> DataFrame:
    f = class_fractions(joined, keys, cls)
    return f.groupBy(*keys).agg(F.max("shannon").alias("shannon"), (1 - F.sum(F.col("fraction") ** 2)).alias("simpson"), F.count("*").alias("classes"))


def composite_cover(df: DataFrame, key: str, dataset: str, group: str, fraction: str, human: list[str]) -> DataFrame:
    """(key, group, composite, shannon, simpson, anthropogenic, natural_share): a group's mean share within each dataset, then over datasets.

    A dataset without a group has no say on it. Diversities are those of the composite made to sum to 1; `human` lists the groups that are not natural.
    """
    one = df.where(F.col(fraction).isNotNull()).groupBy(key, dataset, group).agg(F.avg(fraction).alias("_f"))
    d = one.groupBy(key, group).agg(F.avg("_f").alias("composite"))
    w = W.partitionBy(key)
    p = F.col("composite") / F.nullif(F.sum("composite").over(w), F.lit(0.0))
    d = d.withColumn("_p", p).withColumn("shannon", -F.sum(F.when(F.col("_p") > 0, F.col("_p") * F.log("_p")).otherwise(0.0)).over(w)).withColumn("simpson", 1 - F.sum(F.col("_p") ** 2).over(w))
    made = F.sum(F.when(F.col(group).isin(human), F.col("composite")).otherwise(0.0)).over(w)
    return d.withColumn("anthropogenic", made).withColumn("natural_share", F.sum("composite").over(w) - F.col("anthropogenic")).drop("_p")


def height_distribution(joined: DataFrame, keys: list[str], col: str, tall: float) -> DataFrame:
    p = F.percentile(col, F.array(*[F.lit(x) for x in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    d = joined.groupBy(*keys).agg(F.count(col).alias("n"), F.skewness(col).alias("skew"), F.kurtosis(col).alias("kurt"), p.alias("_p"), F.avg((F.col(col) >= tall).cast("double")).alias("tall_share")).where("n > 10")
    return d.select(*keys, "n", "skew", "kurt", *[F.col("_p")[i].alias(f"p{x}") for i, x in enumerate((5, 25, 50, 75, 95))], "tall_share")


def weighted_stats(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    v, w = F.col(value), F.when(F.col(value).isNotNull(), F.col(weight))
    m = F.sum(w * v) / F.sum(w)
    return df.groupBy(*keys).agg(m.alias("w_mean"), F.sqrt(F.greatest(F.lit(0.0), F.sum(w * v * v) / F.sum(w) - m * m)).alias("w_std"), F.min(v).alias("lo"), F.max(v).alias("hi"))


def grid_cells(lats: DataFrame, lons: DataFrame) -> DataFrame:
    """Cells of a regular grid (i, lat), (j, lon): centre plus or minus half the first spacing (0.125 for one value),
    numbered lon-major. The axes are small; their product is the grid itself."""
    def half(d: DataFrame, k: str, c: str) -> Column:
        a = d.orderBy(k).limit(2).select(c).collect()
        return F.lit(abs(a[1][0] - a[0][0]) / 2 if len(a) > 1 else 0.125)

    hy, hx = half(lats, "i", "lat"), half(lons, "j", "lon")
    n = lats.agg(F.count("*").alias("_n"))
    g = lons.crossJoin(lats).crossJoin(n)
    return g.select((F.col("j") * F.col("_n") + F.col("i")).alias("cell_id"), (F.col("lon") - hx).alias("xmin"), (F.col("lon") + hx).alias("xmax"), (F.col("lat") - hy).alias("ymin"), (F.col("lat") + hy).alias("ymax"))


def overlap_weights(cells: DataFrame, zones: DataFrame, half: float = 0.5, size: float = 8.0) -> DataFrame:
    """(unit_id, cell_id, area, w): areas of cell squares in zone boxes, weights summing to 1 over a unit."""
    j = cells_touching_zones(cells, zones, half, size)
    wide = F.least(F.col("x") + half, F.col("xmax")) - F.greatest(F.col("x") - half, F.col("xmin"))
    high = F.least(F.col("y") + half, F.col("ymax")) - F.greatest(F.col("y") - half, F.col("ymin"))
    a = j.select("unit_id", "cell_id", (wide * high).alias("area"))
    return a.withColumn("w", F.col("area") / F.sum("area").over(W.partitionBy("unit_id")))


def remap(grid: DataFrame, weights: DataFrame, ts: str, cols: list[str], fill: float | None = None) -> DataFrame:
    """Unit values as weighted means of their cells at each time; missing cells are left out of the weights."""
    j = grid.join(weights, "cell_id")
    out = j.groupBy("unit_id", ts).agg(*[(F.sum(F.col("w") * F.col(c)) / F.sum(F.when(F.col(c).isNotNull(), F.col("w")))).alias(c) for c in cols])
    return out if fill is None else out.fillna(fill, cols)


def lapse_correct(units: DataFrame, overlap: DataFrame, col: str, rate: float = 0.0065) -> DataFrame:
    """Unit temperature plus sum(w * rate * (forcing elevation - unit elevation)); weights as they are."""
    c = overlap.groupBy("unit_id").agg(F.sum(F.col("w") * rate * (F.col("forcing_elev") - F.col("unit_elev"))).alias("_c"))
    return units.join(c, "unit_id").withColumn(col, F.col(col) + F.col("_c")).drop("_c")


def terrain(cells: DataFrame, value: str = "elev", spacing: float = 1.0) -> DataFrame:
    """Slope in degrees and aspect (clockwise from north) by central differences, one-sided at the edges; flat cells have
    aspect 180. Neighbours are rows and columns of the grid, met by windows over each."""
    row, col = W.partitionBy("y").orderBy("x"), W.partitionBy("x").orderBy("y")

    def diff(w, at: str) -> Column:
        a, b = F.coalesce(F.lag(value).over(w), F.col(value)), F.coalesce(F.lead(value).over(w), F.col(value))
        p, q = F.coalesce(F.lag(at).over(w), F.col(at)), F.coalesce(F.lead(at).over(w), F.col(at))
        return F.when(q > p, (b - a) / ((q - p) * spacing)).otherwise(0.0)

    d = cells.withColumn("_dx", diff(row, "x")).withColumn("_dy", diff(col, "y"))
    flat = (F.col("_dx") == 0) & (F.col("_dy") == 0)
    return d.withColumn("slope", F.degrees(F.atan(F.sqrt(F.col("_dx") ** 2 + F.col("_dy") ** 2)))).withColumn("aspect", F.when(flat, 180.0).otherwise(F.pmod(F.degrees(F.atan2(-F.col("_dx"), -F.col("_dy"))), F.lit(360.0)))).drop("_dx", "_dy")


def terrain_horn(cells: DataFrame, value: str = "elev", spacing: float = 1.0) -> DataFrame:
    """Slope in degrees and aspect as in `terrain`, from the 3x3 window with weights 1, 2, 1: a pass along rows, then one along columns.

    A neighbour that the table lacks counts as the cell itself in each pass.
    """
    row, col = W.partitionBy("y").orderBy("x"), W.partitionBy("x").orderBy("y")

    def beside(fn, w, at: str, what: str, by: int) -> Column:
        return F.when(fn(at).over(w) == F.col(at) + by, fn(what).over(w)).otherwise(F.col(what))

    left, right = beside(F.lag, row, "x", value, -1), beside(F.lead, row, "x", value, 1)
    d = cells.withColumn("_diff", right - left).withColumn("_sum", left + 2 * F.col(value) + right)
    below, above = (lambda c: beside(F.lag, col, "y", c, -1)), (lambda c: beside(F.lead, col, "y", c, 1))
    d = d.withColumn("_dx", (below("_diff") + 2 * F.col("_diff") + above("_diff")) / (8 * spacing)).withColumn("_dy", (above("_sum") - below("_sum")) / (8 * spacing))
    flat = (F.col("_dx") == 0) & (F.col("_dy") == 0)
    aspect = F.when(flat, 180.0).otherwise(F.pmod(F.degrees(F.atan2(-F.col("_dx"), -F.col("_dy"))), F.lit(360.0)))
    return d.withColumn("slope", F.degrees(F.atan(F.sqrt(F.col("_dx") ** 2 + F.col("_dy") ** 2)))).withColumn("aspect", aspect).drop("_dx", "_dy", "_diff", "_sum")


def quantile_class(df: DataFrame, value: str, k: int, name: str = "quantile") -> DataFrame:
    """Class 0..k-1 by the value's exact quantiles at 1/k, 2/k, ..., interpolated; a value at a quantile is in the upper class.

    The values are numbered in a distributed sort; only the 2 (k - 1) values around the quantiles reach the driver.
    """
    numbered = renumber(df.select(value).where(F.col(value).isNotNull()), [value], "_rank")
    n = numbered.count()
    at = [divmod(j * (n - 1), k) for j in range(1, k)]
    found = {r._rank: r[value] for r in numbered.where(F.col("_rank").isin([i + 1 + more for i, _ in at for more in (0, 1)])).collect()} if n else {}
    breaks = [found[i + 1] + (found[i + 2] - found[i + 1]) * rest / k if rest else found[i + 1] for i, rest in at] if n else []
    return df.withColumn(name, F.when(F.col(value).isNotNull(), sum(((F.col(value) >= b).cast("int") for b in breaks), F.lit(0))))


def discretise(joined: DataFrame, keys: list[str], value: str, step: float, classes: list[str]) -> DataFrame:
    """Units by zone, value band (from the least value of all, in steps, the last band closed) and class columns."""
    b = joined.agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    d = joined.crossJoin(F.broadcast(b))
    last = F.greatest(F.lit(0), F.ceil((F.col("_b") - F.col("_a")) / step) - 1)
    d = d.withColumn("band", F.least(F.floor((F.col(value) - F.col("_a")) / step), last).cast("int"))
    return d.groupBy(*keys, "band", *classes).agg(F.count("*").alias("area"), F.avg(value).alias("mean_value"))


def cell_mode(df: DataFrame, cell: str, cls: str) -> DataFrame:
    """Most frequent class of each cell, ties to the smallest."""
    n = df.groupBy(cell, cls).agg(F.count("*").alias("_n"))
    return n.groupBy(cell).agg((-F.max(F.struct("_n", (-F.col(cls)).alias("c")))["c"]).alias("mode"))


def line_density(segments: DataFrame, areas: DataFrame, unit: str, length: str) -> DataFrame:
    s = segments.groupBy(unit).agg(F.count("*").alias("n"), F.sum(length).alias("total"))
    return areas.join(s, unit, "left").select(unit, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"), (F.coalesce("total", F.lit(0.0)) / F.col("area")).alias("density"))


def _boxes(bins: DataFrame, halvings: int, name: str) -> DataFrame:
    """Bins so many times twice as wide (columns name + i, j) with the box of what is in them (name + x0, x1, y0, y1)."""
    up = [F.shiftright(c, halvings).alias(f"{name}{c[1:]}") for c in ("_i", "_j")]
    return bins.groupBy(*up).agg(*[f(c).alias(f"{name}{c[1:]}") for c, f in (("_x0", F.min), ("_x1", F.max), ("_y0", F.min), ("_y1", F.max))])


def near_bins(places: DataFrame, pieces: DataFrame, halvings: int) -> DataFrame:
    """(_pi, _pj, _ni, _nj): for each bin of places the bins of pieces that may hold a piece nearest to one of its places.

    Both frames have a row a bin (_i, _j) with the box of what is in it (_x0, _x1, _y0, _y1). All bins of the coarsest grid meet; in each finer
    one only the parts of what was kept do. Kept is what is no farther than the least distance within which there surely is a piece.
    """
    pairs, bins = None, ["_pi", "_pj", "_ni", "_nj"]
    for k in range(halvings, -1, -1):
        p, n = _boxes(places, k, "_p"), _boxes(pieces, k, "_n")
        if pairs is None:
            both = p.crossJoin(F.broadcast(n)).withColumn("_most", F.lit(float("inf")))
        else:
            of = lambda d, i, j: d.withColumns({"_ui": F.shiftright(i, 1), "_uj": F.shiftright(j, 1)})
            both = pairs.withColumnsRenamed({"_pi": "_ui", "_pj": "_uj"}).join(of(p, "_pi", "_pj"), ["_ui", "_uj"]).drop("_ui", "_uj")
            both = both.withColumnsRenamed({"_ni": "_ui", "_nj": "_uj"}).join(of(n, "_ni", "_nj"), ["_ui", "_uj"])
        gap = [F.greatest(F.lit(0.0), F.col(f"_n{c}0") - F.col(f"_p{c}1"), F.col(f"_p{c}0") - F.col(f"_n{c}1")) for c in "xy"]
        far = [F.greatest(F.col(f"_n{c}1") - F.col(f"_p{c}0"), F.col(f"_p{c}1") - F.col(f"_n{c}0")) for c in "xy"]
        both = both.select(*bins, "_most", *[(x * x + y * y).alias(c) for c, (x, y) in (("_low", gap), ("_high", far))]).where("_low <= _most")
        both = both.withColumn("_most", F.min("_high").over(W.partitionBy("_pi", "_pj")) * (1 + 1e-9))
        pairs = stored(both.where("_low <= _most").select(*bins, "_most"))
    return pairs.select(*bins)


def nearest_segment(points: DataFrame, segments: DataFrame, key: str = "seg") -> DataFrame:
    """Each point (x, y and other columns) with the nearest of the segments (key, x1, y1, x2, y2) and its distance, ties to the
    lowest key. A point without finite coordinates, and any point where there are no segments with such, gets nulls.

    Segments are cut into pieces no longer than a bin is wide, at most three a segment on average; bins are halved while many
    pieces share one. Bins of places find the bins of pieces that may be nearest (`near_bins`), from coarse to fine, so that a
    place far from all segments meets the pieces of a few bins too. Equal segments count once.
    """
    ends = ["x1", "y1", "x2", "y2"]
    sound = lambda d, cs: d.dropna(subset=cs).where(" AND ".join(f"abs({c}) < double('Infinity')" for c in cs))
    s = sound(segments.select(F.col(key).alias("_id"), *[F.col(c).cast("double").alias(c) for c in ends]), ends)
    s = stored(s.groupBy(*ends).agg(F.min("_id").alias("_id")))
    rows = points.withColumns({"_x": F.col("x").cast("double"), "_y": F.col("y").cast("double")})
    places = stored(sound(rows.select("_x", "_y"), ["_x", "_y"]).distinct())
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    side = F.greatest(F.abs(dx), F.abs(dy))
    n, total, *box = s.agg(F.count("*"), F.sum(side), *[f(g(f"{c}1", f"{c}2")) for c in "xy" for f, g in ((F.min, F.least), (F.max, F.greatest))]).first()
    mine = places.agg(*[f(c) for c in ("_x", "_y") for f in (F.min, F.max)]).first()
    none = [F.lit(None).cast(s.schema["_id"].dataType).alias(key), F.lit(None).cast("double").alias("distance")]
    if not n or mine[0] is None:
        return points.select("*", *none)
    x0, y0 = min(box[0], mine[0]), min(box[2], mine[2])
    span, across = max(max(box[1], mine[1]) - x0, max(box[3], mine[3]) - y0), max(box[1] - box[0], box[3] - box[2])
    slack = 1e-14 * max(map(abs, [*box, *mine]))  # coordinates of pieces are rounded

    def cut(width: float) -> DataFrame:
        many = F.greatest(F.lit(1), F.ceil(side / width)).cast("int")
        d = s.withColumn("_m", many).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
        a, b = F.col("_k") / F.col("_m"), (F.col("_k") + 1) / F.col("_m")
        return d.select("_id", *ends, *[f(F.col(f"{c}1") + a * v, F.col(f"{c}1") + b * v).alias(f"_{c}{i}") for c, v in (("x", dx), ("y", dy)) for i, f in enumerate((F.least, F.greatest))])

    def dealt(d: DataFrame, x: Column, y: Column, width: float) -> DataFrame:
        return d.withColumns({"_i": F.floor((x - x0) / width), "_j": F.floor((y - y0) / width)})

    middle = (F.col("_x0") + F.col("_x1")) / 2, (F.col("_y0") + F.col("_y1")) / 2
    width, least = max(total / n, across / n**0.5) or 1.0, max(total / (2 * n), across * 2.0**-40)
    while True:
        pieces = dealt(cut(width), *middle, width)
        crowd = pieces.groupBy("_i", "_j").agg(F.count("*").cast("double").alias("_c")).agg(F.sum(F.col("_c") * F.col("_c")) / F.sum("_c")).first()[0]
        if crowd <= 8 or width <= least:
            break
        width = max(least, width / 2 ** max(1, math.ceil(math.log2(crowd / 8) / 2)))
    pieces = stored(pieces)
    here = dealt(places, F.col("_x"), F.col("_y"), width)
    wide = {c: F.col(c) + (slack if c[-1] == "1" else -slack) for c in ("_x0", "_x1", "_y0", "_y1")}
    bins = stored(_boxes(here.withColumns({"_x0": F.col("_x"), "_x1": F.col("_x"), "_y0": F.col("_y"), "_y1": F.col("_y")}), 0, "_"))
    near = near_bins(bins, stored(_boxes(pieces.withColumns(wide), 0, "_")), max(0, math.ceil(math.log2(max(span / width, 1) / 16))))
    some = near.join(pieces.select(F.col("_i").alias("_ni"), F.col("_j").alias("_nj"), "_id", *ends), ["_ni", "_nj"]).select(F.col("_pi").alias("_i"), F.col("_pj").alias("_j"), "_id", *ends)
    along = ((F.col("_x") - F.col("x1")) * dx + (F.col("_y") - F.col("y1")) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along)), F.lit(0.0))
    off = F.col("x1") + t * dx - F.col("_x"), F.col("y1") + t * dy - F.col("_y")
    d2 = off[0] * off[0] + off[1] * off[1]
    # the least distance first, then the lowest key at it: both sums of a fixed size, no sort of all that meets
    best = stored(here.join(some, ["_i", "_j"]).groupBy("_x", "_y").agg(F.min(d2).alias("_d2")))
    found = dealt(best, F.col("_x"), F.col("_y"), width).join(some, ["_i", "_j"]).where(d2 == F.col("_d2")).groupBy("_x", "_y", "_d2").agg(F.min("_id").alias("_id"))
    return rows.join(found, ["_x", "_y"], "left").select(*points.columns, F.col("_id").alias(key), F.sqrt("_d2").alias("distance"))


def nearest_zone(points: DataFrame, zones: DataFrame) -> DataFrame:
    """Each point with the zone of the nearest centroid, ties to the lowest id: the nearest of segments without length."""
    x, y = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
    return nearest_segment(points, zones.select("unit_id", x.alias("x1"), y.alias("y1"), x.alias("x2"), y.alias("y2")), "unit_id")


def pieces(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells with `piece`: the least cell_id of those that are joined to them by shared sides and have the same values of `by`."""
    from .network import components

    at = cells.select("cell_id", "x", "y", *by)
    side = lambda dx, dy: at.select(F.col("cell_id").alias("b"), (F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), *by)
    near = at.join(side(1, 0).unionByName(side(0, 1)), ["x", "y", *by]).select(F.col("cell_id").alias("a"), "b")
    found = components(near).select(F.col("node").alias("cell_id"), F.col("component").alias("piece"))
    return cells.join(found, "cell_id", "left").withColumn("piece", F.coalesce("piece", "cell_id"))


def allocate(land: DataFrame, zones: DataFrame, cell_area: float, least: float = 0.1) -> DataFrame:
    """(cell_id, nearest, unit_id): land cells outside all zones, given to the zone of the nearest centroid and cut into pieces that hang together.

    Pieces of `least` (km2) or under are dropped; the others are numbered from the greatest unit_id + 1 by nearest zone, then least cell.
    """
    out = land.join(cells_in_zones(land, zones).select("cell_id").distinct(), "cell_id", "left_anti")
    near = nearest_zone(out.select("cell_id", "x", "y"), zones).select("cell_id", "x", "y", F.col("unit_id").alias("nearest"))
    d = pieces(stored(near), ["nearest"])
    size = d.groupBy("nearest", "piece").agg(F.count("*").alias("_n")).where(F.col("_n") * cell_area > least)
    number = renumber(size, ["nearest", "piece"], "_k").crossJoin(F.broadcast(zones.agg(F.coalesce(F.max("unit_id"), F.lit(0)).alias("_max"))))
    return d.join(number.select("nearest", "piece", (F.col("_k") + F.col("_max")).alias("unit_id")), ["nearest", "piece"]).select("cell_id", "nearest", "unit_id")


def with_coast(units: DataFrame, allocated: DataFrame, cell_area: float) -> DataFrame:
    """(unit_id, area, seg, coastal): the units (unit_id, area, seg) and after them the allocated pieces, which drain to no segment (0)."""
    new = allocated.groupBy("unit_id").agg((F.count("*") * cell_area).alias("area")).select("unit_id", "area", F.lit(0).cast("long").alias("seg"), F.lit(True).alias("coastal"))
    return units.select("unit_id", F.col("area").cast("double").alias("area"), F.col("seg").cast("long").alias("seg"), F.lit(False).alias("coastal")).unionByName(new)


def point_unit(points: DataFrame, d: float) -> DataFrame:
    return points.withColumns({"xmin": F.col("x") - d, "xmax": F.col("x") + d, "ymin": F.col("y") - d, "ymax": F.col("y") + d, "down": F.lit(0)})


def lake_stats(lakes: DataFrame, keys: list[str], area: str, depth: str, name: str) -> DataFrame:
    return lakes.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(area).alias("total_area"), F.min(area).alias("lo"), F.max(area).alias("hi"), F.median(area).alias("median"), (F.sum(F.col(area) * F.col(depth)) / F.sum(area)).alias("mean_depth"), F.max(F.struct(F.col(area), (-F.col(name)).alias("k")))["k"].alias("_k")).withColumn("largest", -F.col("_k")).drop("_k")


def lake_indices(lakes: DataFrame, key: str, area: str, volume: str, residence: str, units: DataFrame, unit_area: str) -> DataFrame:
    """For each unit (key, its area): lakes, their share of its area in percent, number by area, volume (in 1e9), and residence time weighted by area; 0 lakes where there are none."""
    r = F.when(F.col(residence).isNotNull(), F.col(area))
    d = lakes.groupBy(key).agg(F.count("*").alias("_n"), F.sum(area).alias("_a"), (F.sum(volume) / 1e9).alias("volume"), (F.sum(r * F.col(residence)) / F.nullif(F.sum(r).cast("double"), F.lit(0.0))).alias("residence"))
    n = F.coalesce("_n", F.lit(0))
    return units.select(key, unit_area).join(d, key, "left").select(key, n.alias("lakes"), (100 * F.coalesce("_a", F.lit(0.0)) / F.col(unit_area)).alias("percent"), (n / F.col(unit_area)).alias("density"), F.coalesce("volume", F.lit(0.0)).alias("volume"), "residence")


def elbow(df: DataFrame, threshold: str, drop: str) -> DataFrame:
    """The threshold after the greatest bend of log drop over log threshold (evenly weighted second difference); of fewer than three the median threshold."""
    w = W.orderBy("_t")
    d = df.select(F.col(threshold).alias("_t"), F.log10(F.col(drop) + 1).alias("_y"))
    d = d.withColumn("_c", F.abs(F.lead("_y").over(w) - 2 * F.col("_y") + F.lag("_y").over(w))).withColumn("_n", F.lead("_t").over(w))
    bend = F.max(F.when(F.col("_c").isNotNull(), F.struct("_c", (-F.col("_t")).alias("k"), "_n")))["_n"]
    return d.agg(F.coalesce(bend.cast("double"), F.median("_t")).alias("threshold"))


def lithology_categories(df: DataFrame, keys: list[str], kind: str, area: str, words: dict[str, list[str]]) -> DataFrame:
    """Share of each category of the area that any takes: the first category one of whose words the type's name holds, in lower case."""
    name, c = F.lower(F.col(kind)), None
    for category, some in words.items():
        hit = reduce(lambda x, y: x | y, [name.contains(w.lower()) for w in some])
        c = F.when(hit, category) if c is None else c.when(hit, category)
    d = df.withColumn("category", c).where("category IS NOT NULL").groupBy(*keys, "category").agg(F.sum(area).alias("_a"))
    return d.withColumn("fraction", F.col("_a") / F.nullif(F.sum("_a").over(W.partitionBy(*keys)), F.lit(0.0))).drop("_a")


def lithology(df: DataFrame, keys: list[str], kind: str, area: str) -> DataFrame:
    """Share of area of each cleaned type, blanks left out, with the dominant type and Shannon diversity."""
    from ..functions.columns import clean_name

    d = df.where(F.trim(F.col(kind)) != "").groupBy(*keys, clean_name(F.col(kind)).alias("kind")).agg(F.sum(area).alias("_a"))
    w = W.partitionBy(*keys)
    d = d.withColumn("fraction", F.col("_a") / F.sum("_a").over(w))
    return d.withColumn("dominant", F.first("kind").over(w.orderBy(F.col("_a").desc(), "kind").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).withColumn("shannon", -F.sum(F.col("fraction") * F.log("fraction")).over(w)).drop("_a")


def class_pairs(df: DataFrame, keys: list[str], land: str, soil: str, fraction: str, least: float) -> DataFrame:
    """Land shares above `least` with the unit's soil: an id for each pair of classes, shares made to sum to 1 again."""
    d = df.where(F.col(fraction) > least)
    ids = d.select(land, soil).distinct().withColumn("slc", F.row_number().over(W.orderBy(land, soil)))
    return d.join(ids, [land, soil]).withColumn(fraction, F.col(fraction) / F.sum(fraction).over(W.partitionBy(*keys)))
