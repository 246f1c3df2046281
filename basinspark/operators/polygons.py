"""Polygons as rings of vertices: points in them, cells they touch, areas they share with cells and with each other.

A polygon is cut into its edges, and every question becomes a sum over edges. With an edge's sign s (+1 above the
inside, -1 below it) a point is inside where the signs of the edges above it sum to 1; the area shared by two
polygons is the sum over pairs of edges of s * t * (integral of the lower of the two). So a polygon of any number
of vertices is spread over many rows, edges meet in bins of x by equi-joins, and partial sums are made in the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def box_ring(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """The ring of a box."""
    corners = ((xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax))
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners])


def _following(ring: Column) -> Column:
    """Each vertex with the next, the last with the first."""
    return F.arrays_zip(ring.alias("p"), F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)).alias("q"))


def ring_area(ring: Column) -> Column:
    """Signed area of a ring (array of x, y), positive if it runs counterclockwise; 0 below three vertices."""
    x0, y0 = ring[0]["x"], ring[0]["y"]  # relative to a vertex, so that far-off coordinates lose no digits
    cross = lambda e: (e["p"]["x"] - x0) * (e["q"]["y"] - y0) - (e["q"]["x"] - x0) * (e["p"]["y"] - y0)
    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(F.aggregate(_following(ring), F.lit(0.0), lambda a, e: a + cross(e)) / 2)


def edges(polygons: DataFrame, key: str, ring: str = "ring", hole: str | None = None) -> DataFrame:
    """(key, x1, y1, x2, y2, s) with x1 < x2: the edges of all rings; s is +1 where the inside lies below, -1 above.

    A polygon may have any number of rows (parts); the column `hole` marks rings that are cut out. Rings may run
    either way round and repeat their first vertex at the end; null rings and rings of no area have no edges.
    """
    r = F.col(ring)
    turn = F.signum(ring_area(r)) * (F.when(F.col(hole), -1).otherwise(1) if hole else 1)
    # the ring is turned into its edges before these are made rows, lest every row carries the ring
    whole = polygons.where(F.size(r) > 2).select(F.col(key), turn.alias("_t"), _following(r).alias("_es")).where("_t <> 0")
    e = whole.select(key, "_t", F.explode("_es").alias("_e")).where("_e.p.x <> _e.q.x")
    back = F.expr("_e.p.x > _e.q.x")
    at = lambda c, first: F.when(back, F.col(f"_e.{'q' if first else 'p'}.{c}")).otherwise(F.col(f"_e.{'p' if first else 'q'}.{c}")).cast("double")
    return e.select(key, at("x", True).alias("x1"), at("y", True).alias("y1"), at("x", False).alias("x2"), at("y", False).alias("y2"), (F.col("_t") * F.when(back, 1).otherwise(-1)).cast("int").alias("s"))


def boxes(polygons: DataFrame, key: str, ring: str = "ring") -> DataFrame:
    """The bounding box of each polygon over all its rows."""
    ends = [f(F.col(ring)[c]).cast("double").alias(n) for n, f, c in (("xmin", F.array_min, "x"), ("xmax", F.array_max, "x"), ("ymin", F.array_min, "y"), ("ymax", F.array_max, "y"))]
    b = polygons.select(key, *ends)
    return b.groupBy(key).agg(*[(F.min if n.endswith("min") else F.max)(n).alias(n) for n in ("xmin", "xmax", "ymin", "ymax")]).where("xmin IS NOT NULL")


def _bins(low: Column, high: Column, size: float) -> Column:
    return F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))


def points_in_polygons(points: DataFrame, polygons: DataFrame, key: str, x: str = "x", y: str = "y", ring: str = "ring", hole: str | None = None, size: float = 8.0) -> DataFrame:
    """Each point with every polygon that holds it. Of a boundary the left and lower side belong to the polygon, so that polygons side by side share no point.

    A ray goes up from the point: the edges of its bin that cover its x and lie above it are summed. size: about
    the width of a polygon. Points that are equal in all columns count as one row each; null coordinates match nothing.
    """
    _id = [F.struct(*points.columns).alias("_point"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")]
    p = points.select(*_id).where("_x IS NOT NULL AND _y IS NOT NULL").groupBy("_point", "_x", "_y").agg(F.count("*").alias("_copies"))
    p = p.withColumn("_bx", F.floor(F.col("_x") / size))
    e = edges(polygons, key, ring, hole).withColumn("_bx", _bins(F.col("x1"), F.col("x2"), size))
    up = F.col("y1") + (F.col("y2") - F.col("y1")) * ((F.col("_x") - F.col("x1")) / (F.col("x2") - F.col("x1")))
    hits = p.join(e, "_bx").where((F.col("x1") <= F.col("_x")) & (F.col("_x") < F.col("x2")) & (F.greatest("y1", "y2") > F.col("_y"))).where(up > F.col("_y"))
    inside = hits.groupBy("_point", "_copies", key).agg(F.sum("s").alias("_n")).where("_n > 0")
    return inside.withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_point.*", key)


def polygon_of_point(points: DataFrame, polygons: DataFrame, key: str, x: str = "x", y: str = "y", ring: str = "ring", hole: str | None = None, size: float = 8.0, required: bool = True) -> DataFrame:
    """Each point (its columns once) with the polygon of lowest key that holds it. Where none does the query fails, or, unless `required`, the key is null."""
    cols = points.columns
    found = points_in_polygons(points, polygons, key, x, y, ring, hole, size).groupBy(*cols).agg(F.min(key).alias(key))
    same = F.lit(True)
    for c in cols:
        same = same & F.col(f"p.{c}").eqNullSafe(F.col(f"f.{c}"))
    out = points.distinct().alias("p").join(found.alias("f"), same, "left").select("p.*", f"f.{key}")
    if not required:
        return out
    return out.withColumn(key, F.when(F.col(key).isNull(), F.raise_error(F.concat(F.lit("No polygon contains the point "), F.to_json(F.struct(*cols))))).otherwise(F.col(key)))


def _above(a: Column, b: Column, length: Column) -> Column:
    """Integral of the positive part of a line that goes from a to b over `length`."""
    top = F.greatest(a, b)
    return F.when((a >= 0) & (b >= 0), length * (a + b) / 2).when((a <= 0) & (b <= 0), F.lit(0.0)).otherwise(length * top * top / (2 * F.abs(a - b)))


def _pieces(e: DataFrame, size: float) -> DataFrame:
    """Edges cut at the bins of x."""
    return e.withColumn("_bx", _bins(F.col("x1"), F.col("x2"), size)).withColumn("_lo", F.greatest("x1", F.col("_bx") * size)).withColumn("_hi", F.least("x2", (F.col("_bx") + 1) * size)).where("_lo < _hi")


def shared_areas(a: DataFrame, b: DataFrame, a_key: str, b_key: str, a_ring: str = "ring", b_ring: str = "ring", a_hole: str | None = None, b_hole: str | None = None, size: float = 8.0, least: float = 1e-9) -> DataFrame:
    """(a_key, b_key, area): what each two polygons share, where that is more than `least`; any rings, convex or not, with holes and parts.

    Pairs are first found by their boxes, dealt into square bins. size: about a polygon's width. The keys' names must differ.
    """
    pair_bins = lambda d, n: d.withColumn(f"_{n}x", _bins(F.col("xmin"), F.col("xmax"), size)).withColumn(f"_{n}y", _bins(F.col("ymin"), F.col("ymax"), size))
    p, q = pair_bins(boxes(a, a_key, a_ring), "p").alias("p"), pair_bins(boxes(b, b_key, b_ring), "q").alias("q")
    meet = F.expr("p._px = q._qx AND p._py = q._qy AND p.xmin < q.xmax AND q.xmin < p.xmax AND p.ymin < q.ymax AND q.ymin < p.ymax")
    own = F.expr(f"p._px = floor(greatest(p.xmin, q.xmin) / {size}) AND p._py = floor(greatest(p.ymin, q.ymin) / {size})")  # a pair that meets in several bins counts once
    pairs = p.join(q, meet).where(own).select(F.col(f"p.{a_key}").alias(a_key), F.col(f"q.{b_key}").alias(b_key), F.expr("greatest(p.ymin, q.ymin)").alias("_base"))
    e = _pieces(edges(a, a_key, a_ring, a_hole), size).selectExpr(f"`{a_key}`", "_bx", "_lo AS al", "_hi AS ah", "x1 AS ax", "y1 AS ay", "(y2 - y1) / (x2 - x1) AS am", "s AS t")
    f = _pieces(edges(b, b_key, b_ring, b_hole), size).selectExpr(f"`{b_key}`", "_bx", "_lo AS bl", "_hi AS bh", "x1 AS bx", "y1 AS by", "(y2 - y1) / (x2 - x1) AS bm", "s AS u")
    m = pairs.join(f, b_key).join(e, [a_key, "_bx"]).withColumn("_l", F.greatest("al", "bl")).withColumn("_h", F.least("ah", "bh")).where("_l < _h")
    line = lambda v, at: F.col(f"{v}y") - F.col("_base") + F.col(f"{v}m") * (F.col(at) - F.col(f"{v}x"))
    m = m.select(a_key, b_key, (F.col("t") * F.col("u")).alias("_s"), (F.col("_h") - F.col("_l")).alias("_w"), *[line(v, at).alias(f"_{v}{at[1]}") for v in "ab" for at in ("_l", "_h")])
    over = _above(F.col("_bl") - F.col("_al"), F.col("_bh") - F.col("_ah"), F.col("_w"))
    lower = F.col("_w") * (F.col("_bl") + F.col("_bh")) / 2 - over  # integral of the lower edge
    return m.groupBy(a_key, b_key).agg(F.sum(F.col("_s") * lower).alias("area")).where(F.col("area") > least)


def cell_rings(cells: DataFrame, half: float = 0.5) -> DataFrame:
    """cell_id and ring of square cells given by their centre."""
    x, y = F.col("x"), F.col("y")
    return cells.select("cell_id", box_ring(x - half, y - half, x + half, y + half).alias("ring"))


def polygon_weights(cells: DataFrame, polygons: DataFrame, key: str = "unit_id", ring: str = "ring", hole: str | None = None, size: float = 8.0) -> DataFrame:
    """(key, cell_id, area, w): areas of cells (cell_id, ring) in polygons, weights summing to 1 over a polygon."""
    a = shared_areas(polygons, cells, key, "cell_id", ring, "ring", hole, size=size)
    return a.withColumn("w", F.col("area") / F.sum("area").over(W.partitionBy(key)))


def cells_touching_polygons(cells: DataFrame, polygons: DataFrame, key: str = "unit_id", ring: str = "ring", hole: str | None = None, half: float = 0.5, size: float = 8.0) -> DataFrame:
    """Cells (cell_id, x, y, ...) whose square shares some area with a polygon, with its key: the all-touched rule."""
    return cells.join(shared_areas(polygons, cell_rings(cells, half), key, "cell_id", ring, "ring", hole, size=size).drop("area"), "cell_id")


def curvilinear_cells(grid: DataFrame, extrapolate: bool = False) -> DataFrame:
    """(cell_id, lon, lat, ring) of a grid (i, j, lat, lon): corners are the cell's centre and those of the next column, the next of both, and the next row; numbered i * columns + j.

    Where there is no next row or column the cell's own centre stands for the one beyond, so that such cells have no area, or,
    with `extrapolate`, the last spacing is carried on.
    """
    def step(d: DataFrame, along: str, across: str, src: str, dst: str) -> DataFrame:
        w, k = W.partitionBy(across).orderBy(along), F.col(along)
        nxt = F.when(F.lead(along).over(w) == k + 1, F.lead(src).over(w))
        last = F.when(F.lag(along).over(w) == k - 1, F.lag(src).over(w))
        beyond = lambda c: F.coalesce(2 * F.col(f"{src}.{c}") - last[c], F.col(f"{src}.{c}")) if extrapolate else F.col(f"{src}.{c}")
        return d.withColumn(dst, F.struct(*[F.coalesce(nxt[c], beyond(c)).alias(c) for c in ("x", "y")]))

    d = grid.select("i", "j", F.struct(F.col("lon").cast("double").alias("x"), F.col("lat").cast("double").alias("y")).alias("a"))
    d = step(step(step(d, "j", "i", "a", "b"), "i", "j", "a", "e"), "i", "j", "b", "c")
    n = grid.agg((F.max("j") + 1).alias("_n"))
    return d.crossJoin(F.broadcast(n)).select((F.col("i") * F.col("_n") + F.col("j")).alias("cell_id"), F.col("a.x").alias("lon"), F.col("a.y").alias("lat"), F.array("a", "b", "c", "e").alias("ring"))
