"""Pieces of land, overlapping intervals and stateful streams against plain computations."""

import datetime as dt
import random

from pyspark.sql import functions as F

from basinspark.operators import network as N
from basinspark.operators import spatial as S
from basinspark.operators import timeseries as T
from basinspark.streaming import gauges as G


def flood(cells):
    at, out = {(x, y): (c, z) for c, x, y, z in cells}, {}
    for c, x, y, z in sorted(cells):
        if c in out:
            continue
        todo = [(x, y)]
        while todo:
            p = todo.pop()
            if p in at and at[p][1] == z and at[p][0] not in out:
                out[at[p][0]] = c
                todo += [(p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)]
    return out


def test_pieces(spark):
    r = random.Random(1)
    spots = r.sample([(x, y) for x in range(40) for y in range(30)], 800)
    cells = [(k, x, y, r.random() < 0.2) for k, (x, y) in enumerate(r.sample(spots, 800))]
    # a long winding river of cells
    cells += [(5000 - k, 100 + (k if (k // 30) % 2 == 0 else 29 - k % 30) % 30, k // 30 * 2, True) for k in range(300)] + [(6000 + k, 100 + (29 if k % 2 == 0 else 0), 2 * k + 1, True) for k in range(9)]
    d = spark.createDataFrame(cells, "cell_id long, x long, y long, z boolean")
    assert {x.cell_id: x.piece for x in S.pieces(d, ["z"]).collect()} == flood(cells)


def test_components(spark):
    r = random.Random(7)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1200)] + [(9, 9), (400, 400)] + [(2000, 2001 + k) for k in range(50)]
    low = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    assert {x.node: x.component for x in N.components(spark.createDataFrame(edges, "a long, b long")).collect()} == low


def test_small_pieces_go_and_others_are_numbered(spark):
    zones = spark.createDataFrame([(3, 0.0, 4.0, 0.0, 4.0), (8, 20.0, 24.0, 0.0, 4.0)], "unit_id long, xmin double, xmax double, ymin double, ymax double")
    land = [(1, 1, 1), (10, 5, 0), (11, 5, 1), (12, 5, 2), (20, 8, 0), (30, 17, 3), (31, 18, 3), (32, 19, 3)]
    got = {r.cell_id: (r.nearest, r.unit_id) for r in S.allocate(spark.createDataFrame(land, "cell_id long, x long, y long"), zones, 0.04).collect()}
    assert got == {10: (3, 9), 11: (3, 9), 12: (3, 9), 30: (8, 10), 31: (8, 10), 32: (8, 10)}
    assert S.allocate(spark.createDataFrame(land[:1], "cell_id long, x long, y long"), zones, 0.04).count() == 0


def test_overlap_against_inequalities(spark):
    r = random.Random(5)
    day = lambda: dt.datetime(2020, 1, 1) + dt.timedelta(hours=r.randrange(20000))
    make = lambda n: [(r.randrange(4), k, *sorted((day(), day()), reverse=r.random() < 0.1)) for k in range(n)]
    a, b = [*make(60), (1, 99, None, day())], make(60)
    d = spark.createDataFrame(a, "k long, i long, start timestamp_ntz, end timestamp_ntz")
    e = spark.createDataFrame(b, "k long, j long, `from` timestamp_ntz, `to` timestamp_ntz")
    got = sorted((x.i, x.j) for x in T.overlap_join(d, e, ["k"]).collect())
    assert got == sorted((i, j) for k, i, s, t in a for m, j, u, w in b if k == m and s is not None and s <= t and u <= w and s <= w and u <= t)


def test_units_of_the_second_source(spark):
    one = spark.range(1).select(F.lit(36.0).alias("v"))
    value = lambda n, u: one.select(T.second_source_unit(n, F.col("v"), u)).first()[0]
    assert [value("prcp", u) for u in ("kg m-2 s-1", "m s-1", "mm s-1", "mm/s", "mm/h")] == [0.01, 1e-5, 1e-5, 0.01, 36.0]
    assert [value("tmean", u) for u in ("K", "degrees Celsius", "Kelvin or Celsius")] == [309.15, 36.0, 36.0]


def test_batches_end_in_the_same_moments(spark, tmp_path):
    r = random.Random(2)
    rows = [(f"g{r.randrange(3)}", dt.datetime(2020, 1, 1) + dt.timedelta(hours=k), r.random(), None if k % 17 == 0 else r.random()) for k in range(200)]
    d = spark.createDataFrame(rows, "g string, ts timestamp, obs double, sim double")
    seen = []
    for files in (1, 4):
        path = f"file://{tmp_path}/{files}"
        for k in range(files):
            part = d.where(F.floor((F.dayofyear("ts") - 1) * files / 9) == k) if files > 1 else d
            part.coalesce(1).write.mode("append").parquet(f"{path}/in")
        s = G.stream_source(spark, f"{path}/in", "g string, ts timestamp, obs double, sim double", files=1)
        got = G.run_updates(G.stream_moments(s, ["g"], "ts", "1 hour", 10**12), path)
        assert got.select("batch").distinct().count() == files and got.where("closed").isEmpty()
        seen.append({x.g: (x.n, *(round(x[m], 9) for m in G.MOMENTS[1:])) for x in G.newest(got, ["g"]).collect()})
    assert seen[0] == seen[1] and sum(v[0] for v in seen[0].values()) == sum(x[3] is not None for x in rows)


def test_an_idle_unit_is_closed(spark, tmp_path):
    path = f"file://{tmp_path}"
    for k, rows in enumerate([[("a", dt.datetime(2020, 1, 1), 1.0, 2.0)], [("b", dt.datetime(2020, 2, 1), 1.0, 1.0)], [("b", dt.datetime(2020, 2, 2), 3.0, 1.0)]]):
        spark.createDataFrame(rows, "g string, ts timestamp, obs double, sim double").coalesce(1).write.mode("append").parquet(f"{path}/in")
    s = G.stream_source(spark, f"{path}/in", "g string, ts timestamp, obs double, sim double", files=1)
    got = G.run_updates(G.stream_moments(s, ["g"], "ts", "1 hour", 86_400_000), path)
    last = {x.g: (x.n, x.closed) for x in G.newest(got, ["g"]).collect()}
    assert last == {"a": (1, True), "b": (2, False)}
