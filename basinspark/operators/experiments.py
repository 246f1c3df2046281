"""Calibration experiments: sensitivity, mutual information, Pareto fronts, histories."""

from __future__ import annotations

import math
from bisect import bisect_left
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import renumber
from ..scratch import folder, stored
from .metrics import correlation


def _long(df: DataFrame, keep: list, cols: list[str], name: str = "parameter", value: str = "v") -> DataFrame:
    d = df.select(*keep, F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in cols])).alias("_x"))
    return d.select(*[c for c in d.columns if c != "_x"], f"_x.{name}", f"_x.{value}")


def decision_impact(df: DataFrame, decisions: list[str], metric: str) -> DataFrame:
    """Mean metric of every option of every decision."""
    long = df.select(metric, F.explode(F.array(*[F.struct(F.lit(c).alias("decision"), F.col(c).cast("string").alias("option")) for c in decisions])).alias("_x"))
    return long.groupBy("_x.decision", "_x.option").agg(F.avg(metric).alias("mean"), F.count(metric).alias("n"))


def best_rows(df: DataFrame, columns: list[str], metrics: dict[str, bool]) -> DataFrame:
    """For each metric (name: is smaller better) the row of the best value, ties to the first in the columns' order."""
    picks = []
    for m, small in metrics.items():
        row = F.struct((F.col(m) if small else -F.col(m)).alias("_v"), *columns)
        picks.append(F.struct(F.lit(m).alias("metric"), F.min(F.when(F.col(m).isNotNull(), row)).alias("r")))
    best = df.agg(F.array(*picks).alias("_b")).select(F.explode("_b").alias("_b"))
    return best.select("_b.metric", *[F.col(f"_b.r.{c}").alias(c) for c in columns])


def combinations(spark: SparkSession, options: dict[str, list[str]]) -> DataFrame:
    """All combinations of short option lists, as a chain of products of one small frame an option; an empty list gives none."""
    frames = [spark.createDataFrame([(o,) for o in dict.fromkeys(values)], f"`{name}` string") for name, values in options.items()]
    return reduce(DataFrame.crossJoin, frames)


def spearman_sensitivity(df: DataFrame, parameters: list[str], score: str) -> DataFrame:
    """|Spearman| of each parameter with the score, ties at their mean rank.

    Rows are numbered by range-partitioned sorts, so that no parameter's values come into one task."""
    long = stored(_long(df.where(F.col(score).isNotNull()), [F.col(score).cast("double").alias("s")], parameters).where("v IS NOT NULL"))

    def ranks(c: str) -> DataFrame:
        n = renumber(long.select("parameter", c), ["parameter", c], "_at").groupBy("parameter", c).agg(F.min("_at").alias("_a"), F.max("_at").alias("_z"))
        first = n.groupBy("parameter").agg(F.min("_a").alias("_first"))  # a row for each of the parameters named
        return n.join(F.broadcast(first), "parameter").select("parameter", c, ((F.col("_a") + F.col("_z")) / 2 - F.col("_first")).alias(f"r_{c}"))

    r = long.join(ranks("v"), ["parameter", "v"]).join(ranks("s"), ["parameter", "s"])
    return r.groupBy("parameter").agg(F.abs(correlation(F.col("r_v"), F.col("r_s"))).alias("spearman"))


def rbd_fast(df: DataFrame, parameters: list[str], score: str, tie: list[str], m: int = 10) -> DataFrame:
    """First-order index of each parameter: samples up and down again in its order, power of harmonics 1..m of the score
    over the total, corrected for bias. Rows are numbered by a range-partitioned sort, not a task for each parameter."""
    long = _long(df, [*tie, F.col(score).cast("double").alias("y")], parameters)
    d = renumber(long.select("parameter", "v", *tie, "y"), ["parameter", "v", *tie], "_at")
    start = d.groupBy("parameter").agg(F.min("_at").alias("_first"), F.count("*").alias("n"))
    d = d.join(F.broadcast(start), "parameter").withColumn("i", F.col("_at") - F.col("_first"))
    # odd positions going up, even ones coming down
    d = d.withColumn("j", F.when(F.col("i") % 2 == 0, F.floor(F.col("i") / 2)).otherwise(F.col("n") - 1 - F.floor(F.col("i") / 2)))
    a = lambda k: 2 * math.pi * k * F.col("j") / F.col("n")
    power = [F.sum(F.col("y") * F.cos(a(k))) ** 2 + F.sum(F.col("y") * F.sin(a(k))) ** 2 for k in range(1, m + 1)]
    n = F.max("n")
    s1 = 2 * sum(power[1:], power[0]) / (n * n) / F.var_pop("y")
    lam = 2.0 * m / n
    return d.groupBy("parameter").agg((s1 - lam / (1 - lam) * (1 - s1)).alias("s1"))


def mutual_information(df: DataFrame, keys: list[str], x: str, y: str, bins: int = 10, least: int = 15) -> DataFrame:
    """Mutual information of two columns by equal-width bins, for groups of enough rows."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    b = d.groupBy(*keys).agg(*[f(c).alias(f"{n}_{k}") for k, c in (("x", x), ("y", y)) for n, f in (("lo", F.min), ("hi", F.max))], F.count("*").alias("n")).where(F.col("n") >= least)
    bin_ = lambda c, k: F.when(F.col(f"hi_{k}") > F.col(f"lo_{k}"), F.least(F.floor((F.col(c) - F.col(f"lo_{k}")) / (F.col(f"hi_{k}") - F.col(f"lo_{k}")) * bins), F.lit(bins - 1))).otherwise(0)
    j = d.join(b, keys).groupBy(*keys, bin_(x, "x").alias("bx"), bin_(y, "y").alias("by"), "n").agg(F.count("*").alias("c"))
    j = j.withColumn("cx", F.sum("c").over(W.partitionBy(*keys, "bx"))).withColumn("cy", F.sum("c").over(W.partitionBy(*keys, "by")))
    return j.groupBy(*keys).agg(F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy")))).alias("mi"))


def mi_significance(df: DataFrame, keys: list[str], x: str, y: str, tie: list[str], n: int = 20, bins: int = 10, percent: float = 0.95) -> DataFrame:
    """Observed information, the percentile of it under n shuffles of y (dealt by MD5 of the shuffle's number and the tie columns, which must tell rows apart), and whether it is above.

    A shuffle pairs the k-th row in one hash order with the k-th in another. Bins need only numbers: both columns are
    narrowed to what counts, and rows with a null are left out first.
    """
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    w = W.partitionBy(*keys, "rep")
    reps = d.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n))))
    text = [F.col(t).cast("string") for t in tie]
    a = reps.select(*keys, "rep", x, F.row_number().over(w.orderBy(F.md5(F.concat_ws(":", *text)))).alias("_i"))
    b = reps.select(*keys, "rep", y, F.row_number().over(w.orderBy(F.md5(F.concat_ws(":", F.col("rep").cast("string"), *text)))).alias("_i"))
    shuffled = mutual_information(a.join(b, [*keys, "rep", "_i"]), [*keys, "rep"], x, y, bins)
    edge = shuffled.groupBy(*keys).agg(F.percentile("mi", F.lit(percent)).alias("edge"))
    return mutual_information(d, keys, x, y, bins).join(edge, keys).withColumn("significant", F.col("mi") > F.col("edge"))


def pareto_front(df: DataFrame, f1: str, f2: str) -> DataFrame:
    """Rows that no other dominates (both objectives greater is better), equal ones kept.

    With two objectives dominance needs no pairs: of each f1 the greatest f2, then the running greatest f2 of all
    greater f1, over one row a distinct f1. These are sorted by ranges; a range takes the greatest f2 of those before it
    from a table of one row a range."""
    top = stored(df.groupBy(f1).agg(F.max(f2).alias("_top")).sort(F.col(f1).desc()).withColumn("_p", F.spark_partition_id()))
    most = top.groupBy("_p").agg(F.max("_top").alias("_m"))
    before = most.select("_p", F.max("_m").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)).alias("_b"))
    ahead = F.greatest(F.max("_top").over(W.partitionBy("_p").orderBy(F.col(f1).desc()).rowsBetween(W.unboundedPreceding, -1)), F.col("_b"))
    front = top.join(F.broadcast(before), "_p").withColumn("_a", ahead).where("_a IS NULL OR _top > _a").select(f1, F.col("_top").alias(f2))
    return df.join(front, [f1, f2], "left_semi")


def pareto_ranks(df: DataFrame, objectives: list[str], block: int = 200_000) -> DataFrame:
    """The number of each row's front, from 0: the length of the longest chain of rows that dominate it (greater is better).

    Equal rows share a front; a row with a null or NaN objective is in none. One objective: the rank among distinct
    values. Two: distinct points are dealt to blocks of about `block` by ranges of both, and the blocks of a diagonal
    are worked on side by side, knowing of all blocks before them only the best point of each front in their own ranges
    and the last front beyond; so 2 * sqrt(points / block) - 1 rounds, whatever the number of fronts. Three: as many rounds, see
    `_ranks_three`. More: every pair may have to be compared, see `_ranks_many`.
    """
    names = [f"_o{k}" for k in range(len(objectives))]
    o = [F.col(c).cast("double").alias(n) for c, n in zip(objectives, names, strict=True)]
    d = df.withColumns(dict(zip(names, [F.col(c).cast("double") + F.lit(0.0) for c in objectives], strict=True)))
    whole = reduce(lambda a, b: a & b, [F.col(n).isNotNull() & ~F.isnan(n) for n in names])
    points = stored(df.select(*o).select(*[(F.col(n) + F.lit(0.0)).alias(n) for n in names]).where(whole).distinct())
    n = points.count()
    if len(names) == 1:
        ranks = renumber(points.withColumn("_k", -F.col("_o0")), ["_k"], "front").select("_o0", (F.col("front") - 1).cast("int").alias("front"))
    elif len(names) == 2:
        ranks = _ranks_two(points, max(1, math.ceil(math.sqrt(n / block))))
    elif len(names) == 3:
        ranks = _ranks_three(points, names, max(1, math.ceil(math.sqrt(n / block))))
    else:
        ranks = _ranks_many(points, names)
    return d.join(ranks, names, "left").drop(*names)


def _ranks_two(points: DataFrame, cuts: int) -> DataFrame:
    probs = [k / cuts for k in range(1, cuts)]
    at = points.approxQuantile(["_o0", "_o1"], probs, 0.1 / cuts) if probs else [[], []]
    place = lambda c, q: F.size(F.filter(F.array(*map(F.lit, q)), lambda v: F.col(c) < v)) if q else F.lit(0)
    points = stored(points.withColumns({"_i": place("_o0", at[0]), "_j": place("_o1", at[1])}))
    path, done = folder(points.sparkSession), None
    shape = "_i int, _j int, _o0 double, _o1 double, front int"

    def fronts(rows: pd.DataFrame) -> pd.DataFrame:
        mine = rows[rows["kind"] == 0].sort_values(["_o0", "_o1"], ascending=False)
        a, b = mine["_o0"].to_numpy(), mine["_o1"].to_numpy()
        least = np.full(len(mine), int(rows.loc[rows["kind"] == 3, "front"].max()) + 1 if (rows["kind"] == 3).any() else 0)
        for kind, value in ((1, a), (2, b)):
            known = rows[rows["kind"] == kind].sort_values("front", ascending=False)
            if len(known):
                # the greatest value of each front or a later one falls with the front's number
                steps = np.maximum.accumulate(known["_o0" if kind == 1 else "_o1"].to_numpy())
                first = np.searchsorted(steps, value, side="left")
                f = np.append(known["front"].to_numpy() + 1, 0)
                least = np.maximum(least, f[first])
        order = np.searchsorted(-np.unique(b)[::-1], -b) + 1  # 1 is the greatest second objective
        tree = [0] * (len(b) + 2)  # prefix maxima of front + 1 by second objective
        out = np.zeros(len(b), np.int32)
        for k, (r, low) in enumerate(zip(order.tolist(), least.tolist(), strict=True)):
            q, best = r, low
            while q:
                best = max(best, tree[q])
                q &= q - 1
            out[k] = best
            while r < len(tree):
                tree[r] = max(tree[r], best + 1)
                r += r & -r
        return mine[["_i", "_j", "_o0", "_o1"]].assign(front=out)

    for diagonal in range(2 * cuts - 1):
        mine = points.where(F.col("_i") + F.col("_j") == diagonal).select("_i", "_j", "_o0", "_o1", F.lit(None).cast("int").alias("front"), F.lit(0).alias("kind"))
        rows = mine
        if done is not None:
            column = done.groupBy("_i", "front").agg(F.max("_o0").alias("_o0")).select("_i", (F.lit(diagonal) - F.col("_i")).alias("_j"), "_o0", F.lit(None).cast("double").alias("_o1"), "front", F.lit(1).alias("kind"))
            row = done.groupBy("_j", "front").agg(F.max("_o1").alias("_o1")).select((F.lit(diagonal) - F.col("_j")).alias("_i"), "_j", F.lit(None).cast("double").alias("_o0"), "_o1", "front", F.lit(2).alias("kind"))
            last = done.groupBy("_i", "_j").agg(F.max("front").alias("front")).withColumn("_x", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1)))).where((F.col("_x") > F.col("_i")) & (F.lit(diagonal) - F.col("_x") > F.col("_j")))
            beyond = last.groupBy("_x").agg(F.max("front").alias("front")).select(F.col("_x").alias("_i"), (F.lit(diagonal) - F.col("_x")).alias("_j"), F.lit(None).cast("double").alias("_o0"), F.lit(None).cast("double").alias("_o1"), "front", F.lit(3).alias("kind"))
            have = mine.select("_i", "_j").distinct()
            rows = mine.unionByName(column.unionByName(row).unionByName(beyond).join(have, ["_i", "_j"], "left_semi"))
        done = stored(rows.groupBy("_i", "_j").applyInPandas(fronts, shape), path)
    return done.select("_o0", "_o1", "front")


def _sweep(a: np.ndarray, b: np.ndarray, c: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The front of each point of a block; known: fronts that are given, else -1.

    Points are taken in falling order of a, b and c. Of each front the points met so far that are greatest in b and c are kept, b rising
    and c falling. Who has a point of one front above has one of each front before, so that the last such front is found by halving.
    """
    out, rows = np.empty(len(a), np.int32), np.lexsort((-c, -b, -a))
    steps: list[tuple[list, list]] = []
    for k, y, z, given in zip(rows.tolist(), b[rows].tolist(), c[rows].tolist(), known[rows].tolist(), strict=True):
        front = given
        if given < 0:
            front, beyond = 0, len(steps)
            while front < beyond:
                middle = (front + beyond) // 2
                ys, zs = steps[middle]
                at = bisect_left(ys, y)
                if at < len(ys) and zs[at] >= z:
                    front = middle + 1
                else:
                    beyond = middle
        out[k] = front
        while len(steps) <= front:
            steps.append(([], []))
        ys, zs = steps[front]
        at = bisect_left(ys, y)
        if at == len(ys) or zs[at] < z:
            end = at + (at < len(ys) and ys[at] == y)
            while at and zs[at - 1] <= z:
                at -= 1
            ys[at:end], zs[at:end] = [y], [z]
    return out


def _ranks_three(points: DataFrame, names: list[str], cuts: int) -> DataFrame:
    """Three objectives: blocks by ranges of the two that take most values, those of a diagonal side by side as in `_ranks_two`.

    Of blocks that are beyond in one of these and share the range of the other, a block needs of each front the points that are greatest
    in that other and the third objective; of blocks beyond in both, the greatest third objective of each front.
    """
    many = points.agg(*[F.approx_count_distinct(n).alias(n) for n in names]).first()
    a, b, c = sorted(names, key=lambda n: -many[n])
    probs = [k / cuts for k in range(1, cuts)]
    at = points.approxQuantile([a, b], probs, 0.1 / cuts) if probs else [[], []]
    place = lambda c, q: F.size(F.filter(F.array(*map(F.lit, q)), lambda v: F.col(c) < v)) if q else F.lit(0)
    points = stored(points.withColumns({"_i": place(a, at[0]), "_j": place(b, at[1])}))
    path, done = folder(points.sparkSession), None
    shape = "_i int, _j int, " + ", ".join(f"{n} double" for n in names) + ", front int"
    columns, top = ["_i", "_j", *names, "front"], F.lit(float("inf"))

    def fronts(rows: pd.DataFrame) -> pd.DataFrame:
        known = rows["front"].fillna(-1).to_numpy().astype(np.int64)
        return rows.assign(front=_sweep(*(rows[n].to_numpy() for n in (a, b, c)), known))[known < 0][columns]

    def greatest(of: str, own: str, other: str) -> DataFrame:
        """Of each front in a range the points that no other is above, in the objectives `own` and c."""
        w = W.partitionBy(of, "front").orderBy(F.col(own).desc(), F.col(c).desc()).rowsBetween(W.unboundedPreceding, -1)
        return done.withColumn("_z", F.max(c).over(w)).where(f"_z IS NULL OR {c} > _z").withColumns({other: top, "_j" if of == "_i" else "_i": F.lit(diagonal) - F.col(of)})

    for diagonal in range(2 * cuts - 1):
        rows = mine = points.where(F.col("_i") + F.col("_j") == diagonal).withColumn("front", F.lit(None).cast("int")).select(*columns)
        if done is not None:
            last = done.groupBy("_i", "_j", "front").agg(F.max(c).alias(c)).withColumn("_x", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1)))).where((F.col("_x") > F.col("_i")) & (F.lit(diagonal) - F.col("_x") > F.col("_j")))
            beyond = last.groupBy("_x", "front").agg(F.max(c).alias(c)).withColumns({"_i": F.col("_x"), "_j": F.lit(diagonal) - F.col("_x"), a: top, b: top})
            for known in (greatest("_i", a, b), greatest("_j", b, a), beyond):
                rows = rows.unionByName(known.select(*columns).join(mine.select("_i", "_j").distinct(), ["_i", "_j"], "left_semi"))
        done = stored(rows.groupBy("_i", "_j").applyInPandas(fronts, shape), path)
    return done.select(*names, "front")


def _ranks_many(points: DataFrame, names: list[str], block: int = 4096) -> DataFrame:
    """Any number of objectives: points in falling order, a block of them after the other.

    A row's front is settled in its block; the block (of bounded size) is then held against all later rows, which
    are spread over the tasks. As every pair may have to be compared, the work grows with the square of the points.
    """
    d = renumber(points.select(*names, *[(-F.col(n)).alias(f"_n{n}") for n in names]), [f"_n{n}" for n in names], "_at").select(*names, ((F.col("_at") - 1) / block).cast("long").alias("_b"), "_at")
    kind = ", ".join(f"{n} double" for n in names) + ", front int"
    left, path, at = stored(d.withColumn("front", F.lit(0))), folder(points.sparkSession), 0
    whole = f"{kind}, _b long, _at long"
    while not left.isEmpty():
        rows = left.where(F.col("_b") == at).orderBy("_at").toPandas()
        v, front = rows[names].to_numpy(), rows["front"].to_numpy().copy()
        for k in range(1, len(v)):
            over = (v[:k] >= v[k]).all(axis=1)
            if over.any():
                front[k] = max(front[k], front[:k][over].max() + 1)
        stored(points.sparkSession.createDataFrame(rows[names].assign(front=front), kind), path)

        def later(batches, v=v, front=front):
            for b in batches:
                x, f = b[names].to_numpy(), b["front"].to_numpy().copy()
                for k in range(0, len(x), 256):
                    over = (v[None] >= x[k : k + 256, None]).all(axis=2)
                    f[k : k + 256] = np.maximum(f[k : k + 256], np.where(over, front[None] + 1, 0).max(axis=1))
                yield b.assign(front=f.astype(np.int32))

        left, at = stored(left.where(F.col("_b") > at).select(*names, "front", "_b", "_at").mapInPandas(later, whole)), at + 1
    if not at:
        return points.withColumn("front", F.lit(0))
    return points.sparkSession.read.schema(kind).parquet(path)


def crowding_distance(df: DataFrame, keys: list[str], key: str, objectives: list[str]) -> DataFrame:
    """Sum over objectives of the span to both neighbours over the range; ends are infinite; a null takes the median."""
    all_, d = W.partitionBy(*keys), df
    for o in objectives:
        d = d.withColumn(o, F.coalesce(F.col(o), F.median(o).over(all_)))
    total = F.lit(0.0)
    for i, o in enumerate(objectives):
        w = all_.orderBy(o, key)
        span = F.lead(o).over(w) - F.lag(o).over(w)
        r = F.max(o).over(all_) - F.min(o).over(all_)
        d = d.withColumn(f"_c{i}", F.when(span.isNull(), F.lit(math.inf)).otherwise(F.when(r > 0, span / r).otherwise(0.0)))
        total = total + F.col(f"_c{i}")
    return d.withColumn("crowding", total).drop(*[f"_c{i}" for i in range(len(objectives))])


def knee_point(front: DataFrame, key: str, f1: str, f2: str) -> DataFrame:
    """The row nearest to (1, 1) after min-max scaling, ties to the lowest key."""
    b = front.agg(F.min(f1).alias("a1"), F.max(f1).alias("b1"), F.min(f2).alias("a2"), F.max(f2).alias("b2"))
    z = lambda c, k: F.when(F.col(f"b{k}") > F.col(f"a{k}"), (F.col(c) - F.col(f"a{k}")) / (F.col(f"b{k}") - F.col(f"a{k}"))).otherwise(1.0)
    d = front.crossJoin(F.broadcast(b)).withColumn("distance", F.sqrt((1 - z(f1, 1)) ** 2 + (1 - z(f2, 2)) ** 2))
    return d.orderBy("distance", key).limit(1).select(key, f1, f2, "distance")


def composite_best(df: DataFrame, key: str, nse: str, kge: str) -> DataFrame:
    """The row of the greatest (nse + 1) / 2 + (kge + 1) / 2, ties to the lowest key; rows with a null are passed over."""
    d = df.withColumn("composite", (F.col(nse) + 1) / 2 + (F.col(kge) + 1) / 2).where("composite IS NOT NULL")
    return d.orderBy(F.col("composite").desc(), key).limit(1).select(key, nse, kge, "composite")


def total_flow(df: DataFrame, time: str, flow: str, least: int = 10) -> DataFrame:
    """Sum of all outlets at each time, and how many; null everywhere where fewer than `least` times are there to score."""
    d = df.groupBy(time).agg(F.sum(flow).alias(flow), F.count("*").alias("n"))
    times = d.agg(F.count("*").alias("_n"))
    return d.crossJoin(F.broadcast(times)).withColumn(flow, F.when(F.col("_n") >= least, F.col(flow))).drop("_n")


def history(df: DataFrame, generation: str, score: str) -> DataFrame:
    """Best, mean, std and valid count of each generation, running best, percent change and generations without progress."""
    g = df.groupBy(generation).agg(F.max(score).alias("best"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.count(score).alias("valid"))
    w = W.orderBy(generation)
    g = g.withColumn("running_best", F.max("best").over(w))
    g = g.withColumn("change_pct", 100 * (F.col("running_best") - F.lag("running_best").over(w)) / F.abs(F.lag("running_best").over(w)))
    g = g.withColumn("_i", F.sum(F.when(F.col("running_best") > F.lag("running_best").over(w), 1).otherwise(0)).over(w))
    return g.withColumn("stagnation", F.row_number().over(W.partitionBy("_i").orderBy(generation)) - 1).drop("_i")


def runtime_summary(df: DataFrame, keys: list[str], seconds: str, ok: str) -> DataFrame:
    """Least, greatest, mean, population std, and the order statistics at positions n//2, int(.95 n), int(.99 n), nulls first.

    Rows are numbered by a range-partitioned sort; a component of any number of runs is spread over tasks."""
    d = renumber(df.select(*keys, F.col(seconds).alias("_v"), F.col(ok).cast("double").alias("_ok")), [*keys, "_v"], "_at")
    start = d.groupBy(*keys).agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    d = d.join(start, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]))
    at = lambda p: F.max(F.when(F.col("_at") - F.col("_first") == F.floor(F.col("_n") * p), F.col("_v")))
    return d.groupBy(*keys).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.avg("_ok").alias("success"))


def uncertainty(df: DataFrame, parameters: list[str]) -> DataFrame:
    long = _long(df, [], parameters)
    p = F.percentile("v", F.array(F.lit(0.05), F.lit(0.95)))
    cv = F.when(F.avg("v") == 0, F.lit(math.inf)).otherwise(F.stddev_pop("v") / F.abs(F.avg("v")))
    return long.groupBy("parameter").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), p[0].alias("p5"), p[1].alias("p95"), cv.alias("cv"))


def forcing_summary(df: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    return _long(df, keys, variables, "variable").groupBy(*keys, "variable").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def area_rollup(df: DataFrame, outer: str, inner: str, value: str, area: str) -> DataFrame:
    """Area sums, area-weighted and plain means by inner unit, outer unit and over all; level says which."""
    g = df.rollup(outer, inner).agg(F.grouping_id().alias("level"), F.sum(area).alias("total"), (F.sum(F.col(value) * F.col(area)) / F.sum(area)).alias("weighted"), F.avg(value).alias("plain"))
    return g


def mean_pairwise_distance(df: DataFrame, keys: list[str], vector: str, block: int = 1000) -> DataFrame:
    """Mean Euclidean distance over all pairs of a population's vectors; null for one vector alone.

    A population is dealt into blocks, and every two blocks meet in one task, which sums their distances: rows are
    copied once for each block, and only sums leave the tasks.
    """
    d = df.where(F.col(vector).isNotNull()).select(*keys, F.col(vector).alias("_v"), F.monotonically_increasing_id().alias("_i"))
    d = stored(d)
    d = d.join(d.groupBy(*keys).agg(F.ceil(F.count("*") / block).alias("_b")), keys).withColumn("_own", F.pmod(F.xxhash64("_i"), "_b"))
    d = d.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b") - 1)))
    d = d.select(*keys, "_v", "_own", F.least("_own", "_other").alias("_x"), F.greatest("_own", "_other").alias("_y"))

    def sums(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = (np.stack(rows["_v"][rows["_own"] == rows[c].iloc[0]].to_numpy()).astype(float) if (rows["_own"] == rows[c].iloc[0]).any() else np.zeros((0, 1)) for c in ("_x", "_y"))
        same, total = rows["_x"].iloc[0] == rows["_y"].iloc[0], 0.0
        if len(x) and len(y):
            total = sum(float(np.sqrt(((y[i + 1 if same else 0 :] - v) ** 2).sum(1)).sum()) for i, v in enumerate(x))
        return rows[keys].head(1).assign(_s=total, _n=len(x) * (len(x) - 1) // 2 if same else len(x) * len(y))

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    got = d.groupBy(*keys, "_x", "_y").applyInPandas(sums, f"{kinds}, _s double, _n long")
    return got.groupBy(*keys).agg((F.sum("_s") / F.nullif(F.sum("_n"), F.lit(0))).alias("mean_distance"))


def total_order(df: DataFrame, parameters: list[str], score: str, n: int = 1024, bins: int = 1024) -> DataFrame:
    """(parameter, st): total-order indices by Jansen's estimator on a surrogate, the mean over parameters of the score interpolated linearly along each.

    Knots are a parameter's distinct values with their mean score. The design is Saltelli's: points A and B of n rows, uniform
    between a parameter's least and greatest value by MD5, and A with one column of B. Knots are put in order
    by a range-partitioned sort and meet the design points in bins, so that no parameter's samples lie in one task.
    """
    long = _long(df.where(F.col(score).isNotNull()), [F.col(score).cast("double").alias("y")], parameters).where("v IS NOT NULL")
    knots = renumber(long.groupBy("parameter", "v").agg(F.avg("y").alias("y")), ["parameter", "v"], "_k").select("parameter", "v", "y", "_k")
    b = knots.groupBy("parameter").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    nxt = knots.select("parameter", (F.col("_k") - 1).alias("_k"), F.col("v").alias("v2"), F.col("y").alias("y2"))
    bin_ = lambda c: F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(c) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    spans = knots.join(nxt, ["parameter", "_k"], "left").join(b, "parameter").withColumns({"v2": F.coalesce("v2", "v"), "y2": F.coalesce("y2", "y")}).withColumn("_bin", F.explode(F.sequence(bin_("v"), bin_("v2")))).select("parameter", "_bin", "v", "y", "v2", "y2", "hi")
    u = lambda s: F.conv(F.substring(F.md5(F.concat_ws(":", "parameter", F.col("i").cast("string"), F.lit(s))), 1, 8), 16, 10).cast("double") / (1 << 32)
    points = b.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("_x", F.explode(F.array(*[F.struct(F.lit(s).alias("s"), (F.col("lo") + u(s) * (F.col("hi") - F.col("lo"))).alias("x")) for s in "AB"])))
    points = points.select("parameter", "i", "_x.s", "_x.x", "lo", "hi").withColumn("_bin", bin_("x")).drop("lo", "hi")
    on = (F.col("v") <= F.col("x")) & ((F.col("x") < F.col("v2")) | (F.col("v") == F.col("hi")))
    value = F.when(F.col("v2") > F.col("v"), F.col("y") + (F.col("y2") - F.col("y")) * (F.col("x") - F.col("v")) / (F.col("v2") - F.col("v"))).otherwise(F.col("y"))
    term = points.join(spans, ["parameter", "_bin"]).where(on).select("parameter", "i", "s", (value / len(parameters)).alias("g"))
    pair = term.groupBy("parameter", "i").agg(F.max(F.when(F.col("s") == "A", F.col("g"))).alias("a"), F.max(F.when(F.col("s") == "B", F.col("g"))).alias("b"))
    total = pair.groupBy("i").agg(F.sum("a").alias("fa"), F.sum("b").alias("fb"))
    spread = total.select(F.explode(F.array("fa", "fb")).alias("f")).agg(F.var_pop("f").alias("_var"))
    effect = pair.groupBy("parameter").agg((F.avg((F.col("a") - F.col("b")) ** 2) / 2).alias("_e"))
    return effect.crossJoin(F.broadcast(spread)).select("parameter", (F.col("_e") / F.nullif(F.col("_var"), F.lit(0.0))).alias("st"))
