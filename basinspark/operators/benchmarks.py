"""Naive benchmark flows from calibration rows, and their scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .metrics import metrics


def split_mid_year(df: DataFrame, keys: list[str], d: str) -> DataFrame:
    """cal: true before the middle of the distinct years (position n // 2 in order)."""
    y = df.groupBy(*keys).agg(F.array_sort(F.collect_set(F.year(d))).alias("_y"))
    mid = F.element_at("_y", (F.floor(F.size("_y") / 2) + 1).cast("int"))
    return df.join(y.select(*keys, mid.alias("_mid")), keys).withColumn("cal", F.year(d) < F.col("_mid")).drop("_mid")


def benchmark_input(flow: DataFrame, forcing: DataFrame, keys: list[str], d: str) -> DataFrame:
    """Daily mean flow and temperature and summed precipitation on the days both have."""
    q = flow.groupBy(*keys, d).agg(F.avg("q").alias("q"))
    p = forcing.groupBy(*keys, d).agg(F.sum("p").alias("p"), F.avg("t").alias("t"))
    return q.join(p, [*keys, d])


PERIODS = {"annual": lambda d: F.year(d), "monthly": lambda d: F.month(d), "daily": lambda d: F.dayofyear(d)}


def flow_benchmarks(df: DataFrame, keys: list[str], d: str) -> DataFrame:
    """Mean and median flow of the calibration rows (cal): constant, by year, month and day of year."""
    c = df.where("cal")
    out = df.join(c.groupBy(*keys).agg(F.avg("q").alias("bm_mean"), F.median("q").alias("bm_median")), keys, "left")
    for n, f in PERIODS.items():
        t = c.groupBy(*keys, f(d).alias("_k")).agg(F.avg("q").alias(f"bm_{n}_mean"), F.median("q").alias(f"bm_{n}_median"))
        out = out.withColumn("_k", f(d)).join(t, [*keys, "_k"], "left").drop("_k")
    return out


def ratio_benchmarks(df: DataFrame, keys: list[str], d: str) -> DataFrame:
    """The calibration rows' runoff ratio times mean precipitation over all, the year, month, day of year, and the day's own."""
    rr = df.where("cal").groupBy(*keys).agg((F.sum("q") / F.sum("p")).alias("_rr"))
    out = df.join(rr, keys, "left").withColumn("rr_all", F.col("_rr") * F.avg("p").over(W.partitionBy(*keys)))
    for n, f in PERIODS.items():
        out = out.withColumn(f"rr_{n}", F.col("_rr") * F.avg("p").over(W.partitionBy(*keys, f(d))))
    return out.withColumn("rr_step", F.col("_rr") * F.col("p")).drop("_rr")


def monthly_ratio_benchmarks(df: DataFrame, keys: list[str], d: str) -> DataFrame:
    """The same with one ratio a calendar month."""
    rr = df.where("cal").groupBy(*keys, F.month(d).alias("_m")).agg((F.sum("q") / F.sum("p")).alias("_rr"))
    out = df.withColumn("_m", F.month(d)).join(rr, [*keys, "_m"], "left")
    out = out.withColumn("mrr_monthly", F.col("_rr") * F.avg("p").over(W.partitionBy(*keys, "_m"))).withColumn("mrr_daily", F.col("_rr") * F.avg("p").over(W.partitionBy(*keys, F.dayofyear(d))))
    return out.withColumn("mrr_step", F.col("_rr") * F.col("p")).drop("_rr", "_m")


def precip_benchmarks(df: DataFrame, keys: list[str], d: str, lags: int = 10, widths: int = 10) -> DataFrame:
    """Runoff ratio times precipitation: as it is, shifted by the lag, and smoothed over the window, that are best on
    the calibration rows. All lags and windows are tried in one pass."""
    rr = df.where("cal").groupBy(*keys).agg((F.sum("q") / F.sum("p")).alias("_rr"))
    w = W.partitionBy(*keys).orderBy(d)
    x = df.join(rr, keys, "left").withColumn("scaled", F.col("_rr") * F.col("p"))
    x = x.withColumn("_l", F.array(*[F.lag("scaled", i).over(w) for i in range(lags + 1)])).withColumn("_w", F.array(*[F.avg("scaled").over(w.rowsBetween(-i, 0)) for i in range(widths + 1)]))
    err = lambda c, i: F.struct(F.avg(F.when(F.col("cal"), (F.col(c)[i] - F.col("q")) ** 2)).alias("e"), F.lit(i).alias("i"))
    best = x.groupBy(*keys).agg(F.array_min(F.array(*[err("_l", i) for i in range(lags + 1)]))["i"].alias("lag"), F.array_min(F.array(*[err("_w", i) for i in range(widths + 1)]))["i"].alias("width"))
    x = x.join(best, keys)
    return x.withColumn("adjusted", F.col("_l")[F.col("lag")]).withColumn("smoothed", F.col("_w")[F.col("width")]).drop("_l", "_w", "_rr")


def _columns(df: DataFrame, keep: list, names: list[str]) -> DataFrame:
    """One row for each benchmark column: keep, benchmark, sim."""
    d = df.select(*keep, F.explode(F.array(*[F.struct(F.lit(n).alias("benchmark"), F.col(n).cast("double").alias("sim")) for n in names])).alias("_b"))
    return d.select(*[c for c in d.columns if c != "_b"], "_b.benchmark", "_b.sim")


def benchmark_scores(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Metrics of each benchmark column against q, apart for calibration and validation rows.

    A benchmark that is one constant correlates with nothing: its kge, kge_prime and r are null.
    """
    return metrics(_columns(df, [*keys, "cal", F.col("q").alias("obs")], names).dropna(subset=["obs", "sim"]), [*keys, "benchmark", "cal"])


def best_benchmarks(scores: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """keys and benchmark of the k highest calibration KGE, ties to the first name; those without a KGE are left out."""
    w = W.partitionBy(*keys).orderBy(F.col("kge").desc(), "benchmark")
    return scores.where("cal AND kge IS NOT NULL").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).select(*keys, "benchmark")


def envelope(df: DataFrame, scores: DataFrame, keys: list[str], d: str, names: list[str], k: int = 5) -> DataFrame:
    """Least and greatest of the k benchmarks of highest calibration KGE, each day."""
    best = best_benchmarks(scores, keys, k).groupBy(*keys).agg(F.collect_set("benchmark").alias("_best"))
    v = F.array(*[F.when(F.array_contains("_best", n), F.col(n)) for n in names])
    return df.join(best, keys).select(*keys, d, F.array_min(F.array_compact(v)).alias("lo"), F.array_max(F.array_compact(v)).alias("hi"))


def duration_envelope(df: DataFrame, scores: DataFrame, keys: list[str], names: list[str], k: int = 5, points: int = 1000) -> DataFrame:
    """keys, point (0 .. points - 1), exceedance, and over the flow-duration curves of the k best benchmarks lo, q25, median, q75, hi.

    A curve has exceedance i / n at its i-th greatest of n values; it is read at `points` even steps from 0 to 1 by
    linear interpolation, the first value standing for what lies before it. Each step joins the two ranks it needs.
    """
    long = _columns(df, keys, names).dropna(subset=["sim"]).join(best_benchmarks(scores, keys, k), [*keys, "benchmark"])
    by = [*keys, "benchmark"]
    curve = long.select(*by, "sim", F.row_number().over(W.partitionBy(*by).orderBy(F.col("sim").desc())).alias("_i"))
    size = curve.groupBy(*by).agg(F.count("*").alias("_n"))
    steps = size.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("exceedance", F.col("point") / max(1, points - 1))
    at = steps.withColumn("_x", F.greatest(F.lit(1.0), F.col("exceedance") * F.col("_n"))).withColumn("_i", F.least(F.col("_n"), F.floor("_x")).cast("int"))
    one = at.join(curve, [*by, "_i"])
    two = curve.select(*by, (F.col("_i") - 1).alias("_i"), F.col("sim").alias("_next"))
    value = F.col("sim") + (F.coalesce("_next", "sim") - F.col("sim")) * (F.col("_x") - F.col("_i"))
    d = one.join(two, [*by, "_i"], "left").select(*keys, "point", "exceedance", value.alias("_v"))
    q = F.percentile("_v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return d.groupBy(*keys, "point", "exceedance").agg(F.min("_v").alias("lo"), q.alias("_q"), F.max("_v").alias("hi")).select(*keys, "point", "exceedance", "lo", F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q75"), "hi")


def benchmark_summary(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Of each benchmark column mean, standard deviation, their ratio and quartiles, nulls left out."""
    q = F.percentile("sim", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    d = _columns(df, keys, names).dropna(subset=["sim"]).groupBy(*keys, "benchmark").agg(F.avg("sim").alias("mean"), F.stddev_samp("sim").alias("std"), q.alias("_q"))
    return d.select(*keys, "benchmark", "mean", "std", (F.col("std") / F.nullif(F.col("mean"), F.lit(0.0))).alias("cv"), F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("q50"), F.col("_q")[2].alias("q75"))


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
