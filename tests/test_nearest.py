"""Nearest segments against brute force, with odd rows; fronts to the last one; known units."""

import math
import random

import numpy as np
import pytest

from basinspark.operators import experiments, network, sets, spatial


def test_nearest_segment(spark):
    r = random.Random(4)
    segs = [(i, *(r.uniform(0, 50) for _ in range(2))) for i in range(60)]
    segs = [(i, x, y, x + r.uniform(-3, 3) * (i % 3), y + r.uniform(-3, 3) * (i % 3)) for i, x, y in segs]
    points = [(i, r.uniform(-5, 55), r.uniform(-5, 55)) for i in range(80)] + [(100, 1e4, -1e4), (101, None, 1.0), (102, 3.0, 3.0), (103, 3.0, 3.0)]
    s = spark.createDataFrame([*segs, (99, None, 1.0, 1.0, 1.0)], "seg int, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame(points, "id int, x double, y double")
    got = {a.id: a for a in spatial.nearest_segment(p, s).collect()}

    def far(x, y, x1, y1, x2, y2):
        n = (x2 - x1) ** 2 + (y2 - y1) ** 2
        t = max(0, min(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / n)) if n else 0
        return math.hypot(x1 + t * (x2 - x1) - x, y1 + t * (y2 - y1) - y)

    assert len(got) == len(points) and got[101].seg is None
    for i, x, y in points:
        if x is not None:
            d, k = min((far(x, y, *e), k) for k, *e in segs)
            assert got[i].seg == k and abs(got[i].distance - d) < 1e-6
    assert [a.seg for a in spatial.nearest_segment(p.limit(1), s.where("false")).collect()] == [None]


def test_all_fronts(spark):
    rows = [(i, float(i % 4), float(i // 4)) for i in range(16)] + [(16, None, 1.0)]
    got = {r.id: r.front for r in experiments.pareto_ranks(spark.createDataFrame(rows, "id int, f1 double, f2 double"), ["f1", "f2"]).collect()}
    assert got == {i: 6 - i % 4 - i // 4 if i < 16 else None for i in range(17)}


def test_no_known_unit(spark):
    d = spark.createDataFrame([(1, 2)], "unit int, v int")
    with pytest.raises(ValueError):
        sets.known_units(d, d.where("false"), "unit")
    assert network.default_segment(spark.createDataFrame([(3, 9), (4, 3)], "seg int, down int")).first().seg == 3


def test_far_places_meet_few_segments(spark):
    # places reach far beyond the segments, as cells beyond a network
    s = spark.range(3000).selectExpr("id AS seg", "id % 40 AS x1", "id div 40 AS y1", "id % 40 + id % 3 AS x2", "id div 40 + id % 2 AS y2")
    p = spark.range(6000).selectExpr("id", "id % 40 AS x", "id div 40 AS y")
    met, plain = [], spatial.near_bins

    def counted(places, pieces, halvings):
        near = plain(places, pieces, halvings)
        met.append((near.count(), near.select("_pi", "_pj").distinct().count()))
        return near

    with pytest.MonkeyPatch.context() as m:
        m.setattr(spatial, "near_bins", counted)
        got = {a.id: (a.seg, a.distance) for a in spatial.nearest_segment(p, s).collect()}
    assert len(met) == 1 and met[0][0] < 40 * met[0][1]
    x, y = np.arange(6000) % 40, np.arange(6000) // 40
    k = np.arange(3000)
    x1, y1, dx, dy = k % 40, k // 40, k % 3, k % 2
    for i in range(0, 6000, 97):
        t = np.clip(((x[i] - x1) * dx + (y[i] - y1) * dy) / np.maximum(dx * dx + dy * dy, 1), 0, 1)
        d2 = (x1 + t * dx - x[i]) ** 2 + (y1 + t * dy - y[i]) ** 2
        assert got[i] == (d2.argmin(), math.sqrt(d2.min()))


def test_long_short_and_equal_segments(spark):
    r = random.Random(12)
    segs = [(i, x, y, x + r.uniform(-1, 1) * 1e-4, y) for i, (x, y) in enumerate((r.gauss(0, 1e-2), r.gauss(0, 1e-2)) for _ in range(400))]
    segs += [(500, -900.0, -900.0, 1000.0, 950.0), (501, 300.0, -800.0, 300.0, 800.0)] + [(600 + i, *segs[i][1:]) for i in range(0, 400, 3)] + [(510 - i, 7.0, 7.0, 7.0, 7.0) for i in range(5)]
    points = [(i, r.gauss(0, 1e-2), r.gauss(0, 1e-2)) for i in range(150)] + [(200 + i, r.uniform(-2000, 2000), r.uniform(-2000, 2000)) for i in range(150)]
    points += [(400, 7.0, 7.0), (401, 1e9, -3.0), (402, float("inf"), 0.0), (403, 300.0, 5.0)]
    s = spark.createDataFrame([*segs, (700, float("nan"), 0.0, 0.0, 0.0)], "seg int, x1 double, y1 double, x2 double, y2 double")
    got = {a.id: a for a in spatial.nearest_segment(spark.createDataFrame(points, "id int, x double, y double"), s).collect()}
    assert len(got) == len(points) and got[402].seg is None and got[400].seg == 506
    k, x1, y1, x2, y2 = map(np.array, zip(*segs, strict=True))
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    for i, x, y in points:
        if math.isfinite(x):
            t = np.clip(np.divide((x - x1) * dx + (y - y1) * dy, n, out=np.zeros(len(n)), where=n > 0), 0, 1)
            d2 = (x1 + t * dx - x) ** 2 + (y1 + t * dy - y) ** 2
            assert (got[i].seg, got[i].distance) == (k[d2 == d2.min()].min(), math.sqrt(d2.min()))
