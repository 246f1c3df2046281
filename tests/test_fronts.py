"""Fronts, sensitivity and curves against plain computations."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basinspark.operators import benchmarks as B
from basinspark.operators import experiments as X


def plain_fronts(points):
    out = {}
    for p in sorted(set(points), reverse=True):
        out[p] = max((out[q] + 1 for q in out if q != p and all(a >= b for a, b in zip(q, p, strict=True))), default=0)
    return out


@pytest.mark.parametrize("k, n, values, block", [(2, 400, 1000, 10), (2, 400, 12, 25), (2, 300, 10**6, 10**6), (1, 80, 20, 10), (3, 300, 15, 10), (4, 120, 1000, 10)])
def test_fronts(spark, k, n, values, block):
    r = random.Random(n + k)
    points = [tuple(float(r.randrange(values)) for _ in range(k)) for _ in range(n)]
    if values == 1000 and k == 2:
        points += [(float(x), float(x)) for x in range(120)]  # many fronts
    rows = [(i, *p) for i, p in enumerate(points)] + [(-1, *[None] * k), (-2, *[float("nan")] * k)]
    d = spark.createDataFrame(rows, "id long, " + ", ".join(f"f{j} double" for j in range(k)))
    got = {x.id: x.front for x in X.pareto_ranks(d, [f"f{j}" for j in range(k)], block).collect()}
    want = plain_fronts(points)
    assert got == {i: want[p] for i, p in enumerate(points)} | {-1: None, -2: None}


def test_blocks_of_many_objectives(spark):
    r = random.Random(3)
    points = [tuple(float(r.randrange(6)) for _ in range(3)) for _ in range(150)]
    d = spark.createDataFrame(points, "_o0 double, _o1 double, _o2 double").distinct()
    got = {tuple(x)[:3]: x.front for x in X._ranks_many(d, ["_o0", "_o1", "_o2"], 7).collect()}
    assert got == plain_fronts(points)


def test_total_order_against_numpy(spark):
    r = np.random.default_rng(5)
    a, b = r.uniform(0, 1, 400), r.uniform(-3, 2, 400).round(1)
    y = np.sin(6 * a) + 0.2 * b
    d = spark.createDataFrame([(float(p), float(q), float(s)) for p, q, s in zip(a, b, y, strict=True)], "a double, b double, y double")
    got = {x.parameter: x.st for x in X.total_order(d, ["a", "b"], "y", n=200, bins=16).collect()}
    import hashlib

    u = lambda p, i, s: int(hashlib.md5(f"{p}:{i}:{s}".encode()).hexdigest()[:8], 16) / 2**32
    g = {}
    for name, v in (("a", a), ("b", b)):
        knots = np.unique(v)
        means = np.array([y[v == k].mean() for k in knots])
        for s in "AB":
            x = np.array([knots[0] + u(name, i, s) * (knots[-1] - knots[0]) for i in range(1, 201)])
            g[name, s] = np.interp(x, knots, means) / 2
    f = {s: g["a", s] + g["b", s] for s in "AB"}
    var = np.var(np.concatenate([f["A"], f["B"]]))
    for name in "ab":
        swapped = f["A"] - g[name, "A"] + g[name, "B"]
        assert abs(got[name] - ((f["A"] - swapped) ** 2).mean() / 2 / var) < 1e-9


def test_duration_envelope_against_numpy(spark):
    r = np.random.default_rng(6)
    q = r.gamma(2, 3, 90)
    cols = {"x": q + r.normal(0, 1, 90), "y": q * 1.3, "z": r.gamma(2, 3, 90), "flat": np.full(90, 2.0)}
    rows = [("g", i, i < 60, float(q[i]), *[None if n == "x" and i % 11 == 0 else float(c[i]) for n, c in cols.items()]) for i in range(90)]
    d = spark.createDataFrame(rows, "k string, d int, cal boolean, q double, " + ", ".join(f"{n} double" for n in cols))
    scores = B.benchmark_scores(d, ["k"], list(cols))
    assert scores.where("benchmark = 'flat' AND kge IS NOT NULL").isEmpty()
    assert {x.benchmark for x in B.best_benchmarks(scores, ["k"], 2).collect()} == {"x", "y"}
    got = B.duration_envelope(d, scores, ["k"], list(cols), 2, 101).orderBy("point").toPandas()
    grid, curves = np.linspace(0, 1, 101), []
    for n in ("x", "y"):
        v = np.sort([x for i, x in enumerate(cols[n]) if not (n == "x" and i % 11 == 0)])[::-1]
        curves.append(np.interp(grid, np.arange(1, len(v) + 1) / len(v), v))
    for name, want in (("lo", np.min(curves, 0)), ("hi", np.max(curves, 0)), ("median", np.median(curves, 0)), ("q25", np.quantile(curves, 0.25, 0))):
        assert np.allclose(got[name], want)


def test_combinations(spark):
    got = X.combinations(spark, {"a": ["x", "y", "x"], "b": ["1", "2", "3"], "c": ["p"]})
    assert got.columns == ["a", "b", "c"] and got.count() == 6
    assert X.combinations(spark, {"a": ["x"], "b": []}).count() == 0


def test_a_link_stands_out_from_shuffles(spark):
    d = spark.range(400).selectExpr("id", "id % 2 AS k", "CAST(id * 7919 % 400 AS DOUBLE) AS x").withColumn("y", F.when(F.col("k") == 0, F.col("x")).otherwise((F.col("id") * 104729 + 13 * F.col("id") % 7) % 400.0))
    got = {r.k: r for r in X.mi_significance(d, ["k"], "x", "y", ["id"], 20, 6).collect()}
    assert got[0].significant and got[0].mi > 1


@pytest.mark.parametrize("values, block", [((8, 8, 8), 20), ((10**6, 10**6, 10**6), 12), ((1, 50, 7), 25), ((1000, 3, 3), 15), ((40, 1, 1), 5)])
def test_three_objectives_in_blocks(spark, values, block):
    r = random.Random(sum(values) + block)
    points = [tuple(float(r.randrange(v)) for v in values) for _ in range(400)]
    points += [(float("inf"), 0.0, 1.0), (0.0, float("inf"), float("inf")), (float("-inf"), 2.0, 2.0)]
    d = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, f0 double, f1 double, f2 double")
    got = {x.id: x.front for x in X.pareto_ranks(d, ["f0", "f1", "f2"], block).collect()}
    want = plain_fronts(points)
    assert got == {i: want[p] for i, p in enumerate(points)}


def test_three_objectives_take_few_rounds(spark, monkeypatch):
    calls, plain = [], X.stored
    monkeypatch.setattr(X, "stored", lambda *a: calls.append(1) or plain(*a))
    d = spark.range(20000).selectExpr("id", "id * 7919 % 10007 AS f0", "id * 31 % 50 AS f1", "id * 37 % 101 AS f2")
    got = X.pareto_ranks(d, ["f0", "f1", "f2"]).orderBy("id").toPandas()
    assert len(calls) < 6
    v, front = got[["f0", "f1", "f2"]].to_numpy(float), got["front"].to_numpy()
    for k in range(0, 20000, 500):
        over = (v[None] >= v[k : k + 500, None]).all(axis=2) & (v[None] > v[k : k + 500, None]).any(axis=2)
        assert (np.where(over, front[None] + 1, 0).max(axis=1) == front[k : k + 500]).all()
