"""Polygons against exact clipping of rings, plain ray casting and fine rasters."""

import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from basinspark.operators import polygons as P

RING = "unit_id long, ring array<struct<x:double,y:double>>, hole boolean"


def star(r, cx, cy, n):
    """A simple ring, mostly not convex."""
    out = []
    for k in range(n):
        a, d = 2 * math.pi * k / n, r.uniform(0.5, 4)
        out.append((cx + d * math.cos(a), cy + d * math.sin(a)))
    return out[::-1] if r.random() < 0.5 else out


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def clip(ring, x0, y0, x1, y1):
    """The part of a ring inside a box, side after side; its area is right even where the ring is not convex."""
    for axis, bound, keep in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out = []
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            ina, inb = (a[axis] - bound) * keep >= 0, (b[axis] - bound) * keep >= 0
            if ina:
                out.append(a)
            if ina != inb:
                t = (bound - a[axis]) / (b[axis] - a[axis])
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
        ring = out
        if not ring:
            return []
    return ring


def inside(ring, x, y):
    n = 0
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (ax <= x) != (bx <= x) and ay + (by - ay) * (x - ax) / (bx - ax) > y:
            n += 1
    return n % 2 == 1


@pytest.fixture(scope="module")
def shapes():
    r = random.Random(4)
    out = [(k, star(r, r.uniform(0, 20), r.uniform(0, 20), r.randint(3, 14)), False) for k in range(25)]
    out += [(25, [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], False), (25, [(2, 2), (2, 5), (6, 5), (6, 2)], True), (25, [(12, 12), (15, 12), (13, 15)], False)]
    return out


@pytest.fixture(scope="module")
def table(spark, shapes):
    odd = [(90, None, False), (91, [], False), (92, [(1.0, 1.0), (2.0, 2.0)], False), (93, [(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], None)]
    return spark.createDataFrame([(k, g and [(float(x), float(y)) for x, y in g], h) for k, g, h in [*shapes, *odd]], RING)


def test_cell_areas_against_clipping(spark, shapes, table):
    cells = spark.createDataFrame([(x * 100 + y, float(x), float(y)) for x in range(-5, 25) for y in range(-5, 25)], "cell_id long, x double, y double")
    got = {(r.unit_id, r.cell_id): (r.area, r.w) for r in P.polygon_weights(P.cell_rings(cells), table, hole="hole", size=3.0).collect()}
    want, whole = {}, {}
    for k, ring, hole in shapes:
        whole[k] = whole.get(k, 0) + abs(area(ring)) * (-1 if hole else 1)
        for x in range(-5, 25):
            for y in range(-5, 25):
                part = clip(ring, x - 0.5, y - 0.5, x + 0.5, y + 0.5)
                if part:
                    want[k, x * 100 + y] = want.get((k, x * 100 + y), 0) + abs(area(part)) * (-1 if hole else 1)
    want = {k: v for k, v in want.items() if v > 1e-9}
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k]) < 1e-9 for k in want)
    for k in whole:
        assert abs(sum(v[0] for (u, _), v in got.items() if u == k) - whole[k]) < 1e-8 and abs(sum(v[1] for (u, _), v in got.items() if u == k) - 1) < 1e-9
    touched = {(r.unit_id, r.cell_id) for r in P.cells_touching_polygons(cells, table, hole="hole", size=3.0).collect()}
    assert touched == want.keys()


def test_areas_do_not_hang_on_the_bins_or_the_place(spark, table):
    other = table.select(F.col("unit_id").alias("other"), "ring")
    far = lambda d: d.withColumn("ring", F.transform("ring", lambda v: F.struct((v["x"] + 1e6).alias("x"), (v["y"] - 5e6).alias("y"))))
    runs = [{(r.unit_id, r.other): r.area for r in P.shared_areas(a, b, "unit_id", "other", size=s, least=1e-6).collect()} for a, b, s in ((table, other, 2.0), (table, other, 50.0), (far(table), far(other), 8.0))]
    assert runs[0].keys() == runs[1].keys() == runs[2].keys()
    assert all(abs(runs[0][k] - run[k]) < 1e-5 for run in runs[1:] for k in run)
    assert all(abs(runs[0][k] - runs[0][k[::-1]]) < 1e-9 for k in runs[0])


def test_two_polygons_against_a_raster(spark, shapes, table):
    got = {(r.unit_id, r.other): r.area for r in P.shared_areas(table.where("unit_id < 25"), table.where("unit_id < 25").withColumnRenamed("unit_id", "other"), "unit_id", "other").collect()}
    rings = {k: g for k, g, _ in shapes if k < 25}
    h = 0.05
    for a, b in [(a, b) for a in range(0, 6) for b in range(a, 25)]:
        n = 0
        xs = [x for g in (rings[a], rings[b]) for x, _ in g]
        ys = [y for g in (rings[a], rings[b]) for _, y in g]
        if (a, b) not in got and (max(x for x, _ in rings[a]) < min(x for x, _ in rings[b]) or max(x for x, _ in rings[b]) < min(x for x, _ in rings[a])):
            continue
        x = min(xs) + h / 2
        while x < max(xs):
            y = min(ys) + h / 2
            while y < max(ys):
                n += inside(rings[a], x, y) and inside(rings[b], x, y)
                y += h
            x += h
        assert abs(got.get((a, b), 0) - n * h * h) < 0.35


def test_points(spark, shapes, table):
    r = random.Random(9)
    points = [(k, r.uniform(-2, 22), r.uniform(-2, 22)) for k in range(800)] + [(1000, 0.0, 0.0), (1001, 10.0, 5.0), (1002, 5.0, 10.0), (1003, 3.0, 3.0), (1004, 2.0, 2.0), (1005, None, 1.0), (1006, 13.0, 13.0)]
    d = spark.createDataFrame(points, "id long, x double, y double")
    got = sorted((q.id, q.unit_id) for q in P.points_in_polygons(d, table, "unit_id", hole="hole", size=3.0).collect())
    want = []
    for i, x, y in points:
        for k in {k for k, _, _ in shapes}:
            if x is not None and sum(inside(g, x, y) * (-1 if h else 1) for j, g, h in shapes if j == k) > 0:
                want.append((i, k))
    assert got == sorted(want)
    mine = {q.id: q.unit_id for q in P.polygon_of_point(d, table, "unit_id", hole="hole", required=False).collect()}
    assert mine == {i: min((k for j, k in want if j == i), default=None) for i, _, _ in points}
    has = {j for j, k in want if k == 25}
    assert {1000, 1006} <= has and not {1001, 1002, 1003, 1004} & has  # left and lower sides belong, right, upper and the hole's do not


def test_a_point_in_no_polygon_fails(spark, table):
    d = spark.createDataFrame([(1, 500.0, 500.0)], "id long, x double, y double")
    with pytest.raises(PySparkException, match="No polygon contains"):
        P.polygon_of_point(d, table, "unit_id").collect()


def test_curvilinear(spark):
    grid = spark.createDataFrame([(i, j, i + 0.1 * j, j * 2.0 + 0.3 * i * i) for i in range(4) for j in range(5)], "i long, j long, lat double, lon double")
    rings = {r.cell_id: [(v.x, v.y) for v in r.ring] for r in P.curvilinear_cells(grid).collect()}
    assert rings[6] == [(2.3, 1.1), (4.3, 1.2), (5.2, 2.2), (3.2, 2.1)] and abs(area(rings[19])) == 0 == abs(area(rings[4]))
    more = {r.cell_id: [(v.x, v.y) for v in r.ring] for r in P.curvilinear_cells(grid, extrapolate=True).collect()}
    assert more[6] == rings[6] and all(abs(area(g)) > 1 for g in more.values())
    assert [tuple(round(c, 9) for c in v) for v in more[9]] == [(8.3, 1.4), (10.3, 1.5), (11.2, 2.5), (9.2, 2.4)]
    gap = P.curvilinear_cells(grid.where("NOT (i = 1 AND j = 2)")).where("cell_id = 6").first().ring
    assert [(v.x, v.y) for v in gap] == [(2.3, 1.1), (2.3, 1.1), (5.2, 2.2), (3.2, 2.1)]
    one = spark.createDataFrame([(0, 0, 1.0, 2.0)], "i long, j long, lat double, lon double")
    assert [(v.x, v.y) for v in P.curvilinear_cells(one, extrapolate=True).first().ring] == [(2.0, 1.0)] * 4


def test_a_large_ring_is_spread_over_rows(spark):
    n = 20000
    ring = [(5 * math.cos(2 * math.pi * k / n), 5 * math.sin(2 * math.pi * k / n)) for k in range(n)]
    d = spark.createDataFrame([(1, ring, False)], RING)
    cells = spark.range(-6, 7).selectExpr("id AS x").crossJoin(spark.range(-6, 7).selectExpr("id AS y")).selectExpr("(x + 6) * 100 + y + 6 AS cell_id", "x", "y")
    got = P.polygon_weights(P.cell_rings(cells), d, size=1.0).agg(F.sum("area"), F.max("area")).first()
    assert abs(got[0] - area(ring)) < 1e-6 and abs(got[1] - 1) < 1e-9
