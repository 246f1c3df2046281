"""Regular grids, gap filling, joins in time, and signatures of series by any keys."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .metrics import correlation

STEPS = {"h": ("hour", "INTERVAL 1 HOUR"), "D": ("day", "INTERVAL 1 DAY"), "M": ("month", "INTERVAL 1 MONTH"), "Y": ("year", "INTERVAL 1 YEAR")}

def floor_to(ts: Column, freq: str) -> Column:
    """The start of the step: h, D, M, Y, or `<n>s` seconds counted from the epoch."""
    if freq in STEPS:
        return F.date_trunc(STEPS[freq][0], ts)
    n = int(freq[:-1])
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts.cast("timestamp")) / n) * n).cast("timestamp_ntz")


def spine(df: DataFrame, keys: list[str], ts: str, freq: str) -> DataFrame:
    """keys, ts: every step from the first to the last of each key; one row a key travels, the rest is made in place."""
    step = F.expr(STEPS[freq][1] if freq in STEPS else f"INTERVAL {int(freq[:-1])} SECOND")
    b = df.groupBy(*keys).agg(F.min(floor_to(F.col(ts), freq)).alias("_a"), F.max(floor_to(F.col(ts), freq)).alias("_b"))
    return b.select(*keys, F.explode(F.sequence("_a", "_b", step)).alias(ts))


def resample(df: DataFrame, keys: list[str], ts: str, freq: str, aggs: dict[str, str]) -> DataFrame:
    """Left-closed bins with every bin present; an empty one sums to 0, all else is null. aggs: column to mean, sum, min, max or count."""
    fn = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
    got = df.groupBy(*keys, floor_to(F.col(ts), freq).alias(ts)).agg(*[fn[a](c).alias(c) for c, a in aggs.items()])
    out = spine(df, keys, ts, freq).join(got, [*keys, ts], "left")
    return out.select(*keys, ts, *[F.coalesce(c, F.lit(0)).alias(c) if a in ("sum", "count") else F.col(c) for c, a in aggs.items()])


def interpolate(df: DataFrame, keys: list[str], ts: str, col: str, limit: int | None = None, both: bool = False, by: str = "row") -> DataFrame:
    """Fills nulls linearly over row numbers, or with by="time" over the times between, `limit` at most after each valid one, also in longer gaps; trailing
    nulls hold the last value within the limit; leading ones stay unless `both`."""
    w = W.partitionBy(*keys).orderBy(ts)
    d = df.withColumn("_i", F.row_number().over(w))
    if by not in ("row", "time"):
        raise ValueError(f"by is row or time, not {by}")
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) if by == "time" else F.col("_i")
    d = d.withColumn("_x", seconds)
    at = F.when(F.col(col).isNotNull(), F.struct("_i", "_x", F.col(col).alias("v")))
    d = d.withColumn("_l", F.last(at, True).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_n", F.first(at, True).over(w.rowsBetween(0, W.unboundedFollowing)))
    since = F.col("_i") - F.col("_l._i")
    line = F.col("_l.v") + (F.col("_n.v") - F.col("_l.v")) * (F.col("_x") - F.col("_l._x")) / (F.col("_n._x") - F.col("_l._x"))
    after = F.when(F.col("_n").isNull(), F.col("_l.v")).otherwise(line)
    ok = F.lit(True) if limit is None else since <= limit
    fill = F.when(F.col("_l").isNotNull() & ok, after)
    if both:
        back = F.lit(True) if limit is None else F.col("_n._i") - F.col("_i") <= limit
        fill = F.coalesce(fill, F.when(F.col("_l").isNull() & back, F.col("_n.v")))
    return d.withColumn(col, F.coalesce(F.col(col), fill)).drop("_i", "_x", "_l", "_n")


def fill_linear(df: DataFrame, keys: list[str], ts: str, col: str, default: float) -> DataFrame:
    """Linear in between, first and last values held outward, a default where a key has no value."""
    d = interpolate(df, keys, ts, col, both=True)
    return d.withColumn(col, F.coalesce(col, F.lit(default)))


# What a forcing variable is filled with where a series has no value at all.
FILL_DEFAULTS = {"airtemp": 273.15, "airpres": 101325.0, "spechum": 0.005, "windspd": 2.0, "LWRadAtm": 300.0, "SWRadAtm": 0.0, "pptrate": 0.0}


def cubic_spline(at: np.ndarray, values: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The not-a-knot cubic through four or more points, continued beyond them; linear through two or three."""
    piece = np.clip(np.searchsorted(at, where, "right") - 1, 0, len(at) - 2)
    h = np.diff(at)
    slope = np.diff(values) / h
    left = where - at[piece]
    if len(at) < 4:
        return values[piece] + slope[piece] * left
    # second derivatives at the inner points: three diagonals, the outer two points eliminated
    low, main, high, right = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy(), 6 * np.diff(slope)
    first, last = h[0] / h[1], h[-1] / h[-2]
    main[0] += h[0] * (1 + first)
    high[0] -= h[0] * first
    main[-1] += h[-1] * (1 + last)
    low[-1] -= h[-1] * last
    for k in range(1, len(main)):
        f = low[k] / main[k - 1]
        main[k] -= f * high[k - 1]
        right[k] -= f * right[k - 1]
    m = np.empty(len(at))
    m[-2] = right[-1] / main[-1]
    for k in range(len(main) - 2, -1, -1):
        m[k + 1] = (right[k] - high[k] * m[k + 2]) / main[k]
    m[0], m[-1] = m[1] + first * (m[1] - m[2]), m[-2] + last * (m[-2] - m[-3])
    b = slope - h * (2 * m[:-1] + m[1:]) / 6
    return values[piece] + left * (b[piece] + left * (m[piece] / 2 + left * (m[piece + 1] - m[piece]) / (6 * h[piece])))


def fill_spline(df: DataFrame, keys: list[str], ts: str, col: str, default: float, low: float, high: float) -> DataFrame:
    """Nulls by a cubic spline over row numbers, a series (one unit's) in a task; then all values clipped to low..high."""

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(ts, kind="stable", ignore_index=True)
        v = rows[col].to_numpy(dtype=float, na_value=np.nan)
        at = np.flatnonzero(~np.isnan(v))
        rows[col] = np.clip(cubic_spline(at.astype(float), v[at], np.arange(len(v), dtype=float)) if len(at) > 1 else np.full(len(v), default), low, high)
        return rows

    d = df.withColumn(col, F.col(col).cast("double"))
    return d.groupBy(*keys).applyInPandas(fill, d.schema)


def fill_forcing(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Fills the forcing variables (FILL_DEFAULTS) that the table has, each by its rule.

    Precipitation: 0. Air temperature of which more than half of all values are null: a cubic spline, within 200 to 350. The
    others linearly over time, the first and last value held outward, a default where a series has none; if
    more than 80 % of one are null, ValueError (not for short-wave radiation). A variable without nulls stays as it is.
    """
    have = [c for c in FILL_DEFAULTS if c in df.columns]
    if not have:
        return df
    share = df.agg(*[F.coalesce(F.avg(F.col(c).isNull().cast("int")), F.lit(0.0)).alias(c) for c in have]).first()
    poor = [c for c in have if share[c] > 0.8 and c not in ("airtemp", "pptrate", "SWRadAtm")]
    if poor:
        raise ValueError(f"more than 80 % null: {', '.join(poor)}")
    for c in have:
        if share[c] and c == "pptrate":
            df = df.withColumn(c, F.coalesce(c, F.lit(0.0)))
        elif c == "airtemp" and share[c] > 0.5:
            df = fill_spline(df, keys, ts, c, FILL_DEFAULTS[c], 200.0, 350.0)
        elif share[c]:
            df = interpolate(df, keys, ts, c, both=True, by="time").withColumn(c, F.coalesce(c, F.lit(FILL_DEFAULTS[c])))
    return df


def reindex_nearest(df: DataFrame, keys: list[str], ts: str, col: str, grid: DataFrame) -> DataFrame:
    """The nearest point's value at each time of `grid` (keys, ts); the later point wins a tie."""
    return _two_sides(grid, df, keys, ts, col, lambda before, after, near: F.when(after <= before, F.col("_n.v")).otherwise(F.col("_l.v")))


def _two_sides(left: DataFrame, right: DataFrame, keys: list[str], ts: str, col: str, pick) -> DataFrame:
    """As-of on both sides in one pass: rows of both are ordered together and nulls skipped."""
    l = left.select(*keys, ts, F.lit(None).cast(right.schema[col].dataType).alias("_v"), F.lit(1).alias("_ask"))
    r = right.select(*keys, ts, F.col(col).alias("_v"), F.lit(0).alias("_ask")).where(F.col("_v").isNotNull())
    w = W.partitionBy(*keys).orderBy(ts, "_ask")
    v = W.partitionBy(*keys).orderBy(F.col(ts), F.col("_ask").desc())
    point = F.when(F.col("_ask") == 0, F.struct(F.col(ts).alias("t"), F.col("_v").alias("v")))
    d = l.unionByName(r).withColumn("_l", F.last(point, True).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_n", F.first(point, True).over(v.rowsBetween(0, W.unboundedFollowing)))
    sec = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    before, after = sec(F.col(ts)) - sec(F.col("_l.t")), sec(F.col("_n.t")) - sec(F.col(ts))
    before, after = F.coalesce(before, F.lit(math.inf)), F.coalesce(after, F.lit(math.inf))
    d = d.where("_ask = 1")
    return d.select(*keys, ts, pick(before, after, F.least(before, after)).alias(col))


def interp_join(left: DataFrame, right: DataFrame, keys: list[str], ts: str, col: str) -> DataFrame:
    """The right series linearly interpolated at the left times; null outside its range."""
    both = F.col("_l").isNotNull() & F.col("_n").isNotNull()
    line = lambda before, after, near: F.when(both, F.when(before + after == 0, F.col("_l.v")).otherwise(F.col("_l.v") + (F.col("_n.v") - F.col("_l.v")) * before / (before + after)))
    return _two_sides(left, right, keys, ts, col, line)


def nearest_join(left: DataFrame, right: DataFrame, keys: list[str], ts: str, col: str, tolerance_s: float = 1800) -> DataFrame:
    """Left times with the nearest right value within the tolerance; others are dropped; the earlier point wins a tie."""
    pick = lambda before, after, near: F.when(near <= tolerance_s, F.when(before <= after, F.col("_l.v")).otherwise(F.col("_n.v")))
    return _two_sides(left, right, keys, ts, col, pick).where(F.col(col).isNotNull())


def gap_report(df: DataFrame, keys: list[str], ts: str, step_s: int, longest_s: int = 20 * 86400) -> DataFrame:
    """Rows there and expected, median step, share of steps within 1 % of the nominal, and whether no gap is too long."""
    sec = F.unix_timestamp(F.col(ts).cast("timestamp"))
    d = df.withColumn("_s", sec - F.lag(sec).over(W.partitionBy(*keys).orderBy(ts))).withColumn("_t", sec)
    near = F.abs(F.col("_s") - step_s) <= 0.01 * step_s
    return d.groupBy(*keys).agg(F.count("*").alias("n"), (F.floor((F.max("_t") - F.min("_t")) / step_s) + 1).alias("expected"), F.median("_s").alias("median_step"), F.avg(near.cast("double")).alias("regular_share"), F.coalesce(F.max("_s") <= longest_s, F.lit(True)).alias("continuous"))


def to_timestep(df: DataFrame, keys: list[str], ts: str, col: str, freq: str) -> DataFrame:
    """Means where the series is finer than the step, interpolation where it is coarser; nulls are dropped."""
    return interpolate(resample(df, keys, ts, freq, {col: "mean"}), keys, ts, col, both=True).dropna(subset=[col])


def adapt_timestep(df: DataFrame, keys: list[str], ts: str, col: str, freq: str) -> DataFrame:
    """Hourly (h) or daily (D) series, by each key's own step, the second time minus the first.

    A step near the wanted one (45 to 75 minutes, 20 to 28 hours), or a single time, leaves the series as it is. A finer one is
    averaged, a coarser one laid on the regular grid (values on the grid's times only) and filled by time to both
    sides; of these, steps without a value are left out. A series is ordered inside one task; a key may be null.
    """
    nominal, low, high = {"h": (3600, 2700, 4500), "D": (86400, 72000, 100800)}[freq]
    w = W.partitionBy(*keys).orderBy(ts)
    all_ = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    d = df.withColumn("_step", F.when(F.row_number().over(w) == 1, F.lead(seconds).over(w) - seconds)).withColumn("_step", F.max("_step").over(all_))
    near = F.col("_step").isNull() | F.col("_step").between(low, high)
    plain = [*keys, ts, col]
    fine = d.where(~near & (F.col("_step") < nominal)).groupBy(*keys, floor_to(F.col(ts), freq).alias(ts)).agg(F.avg(col).alias(col))
    slow = d.where(~near & (F.col("_step") > nominal))
    grid = spine(slow, keys, ts, freq).alias("g")
    same = F.col(f"g.{ts}") == F.col(f"s.{ts}")
    for k in keys:
        same = same & F.col(f"g.{k}").eqNullSafe(F.col(f"s.{k}"))
    on_grid = grid.join(slow.alias("s"), same, "left").select(*[f"g.{k}" for k in keys], f"g.{ts}", f"s.{col}")
    slow = interpolate(on_grid, keys, ts, col, both=True, by="time")
    return d.where(near).select(*plain).unionByName(fine.dropna(subset=[col])).unionByName(slow.dropna(subset=[col]).select(*plain))


def match_cadence(obs: DataFrame, sim: DataFrame, keys: list[str], ts: str, col: str) -> DataFrame:
    """The simulation as daily means where the observations' median step is 23 hours or more, else as it is."""
    step = gap_report(obs, keys, ts, 86400).select(*keys, (F.col("median_step") >= 23 * 3600).alias("_daily"))
    s = sim.join(step, keys).withColumn("_at", F.when(F.col("_daily"), F.date_trunc("day", ts)).otherwise(F.col(ts)))
    return s.groupBy(*keys, F.col("_at").alias(ts)).agg(F.avg(col).alias(col))


def shift_daily(df: DataFrame, keys: list[str], ts: str, col: str, hours: int) -> DataFrame:
    """Daily min, mean, max and sum after moving times by whole hours."""
    moved = F.col(ts) + F.expr(f"INTERVAL {int(hours)} HOURS")
    return df.groupBy(*keys, F.to_date(moved).alias("d")).agg(F.min(col).alias("lo"), F.avg(col).alias("mean"), F.max(col).alias("hi"), F.sum(col).alias("total"))


def year_months(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.select("*", F.explode(F.sequence(F.trunc(start, "MM"), F.col(end), F.expr("INTERVAL 1 MONTH"))).alias("_m")).withColumn("ym", F.date_format("_m", "yyyyMM")).drop("_m")


def water_year(d: Column) -> Column:
    return F.year(d) + (F.month(d) >= 10).cast("int")


def seasonal_metrics(pairs: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Amplitude ratio of the monthly cycles and the months between their peaks, around the year."""
    m = pairs.groupBy(*keys, F.month(ts).alias("m")).agg(F.avg("obs").alias("o"), F.avg("sim").alias("s"), F.count("*").alias("n"))
    peak = lambda c: F.max(F.struct(F.col(c), (-F.col("m")).alias("k")))["k"]
    a = m.groupBy(*keys).agg(((F.max("s") - F.min("s")) / (F.max("o") - F.min("o"))).alias("amplitude_ratio"), (peak("o") - peak("s")).alias("_p"), F.sum("n").alias("_n")).where("_n > 365")
    off = F.abs("_p")
    return a.select(*keys, "amplitude_ratio", F.when(off > 6, 12 - off).otherwise(off).alias("phase_months"))


def anomaly_corr(pairs: DataFrame, keys: list[str], ts: str, before: int = 6, after: int = 5) -> DataFrame:
    """Correlation of what is left after a centred mean over before + after + 1 rows, all of which must be there."""
    w = W.partitionBy(*keys).orderBy(ts).rowsBetween(-before, after)
    off = lambda c: F.when(F.count(c).over(w) == before + after + 1, F.col(c) - F.avg(c).over(w))
    d = pairs.withColumn("_o", off("obs")).withColumn("_s", off("sim")).where("_o IS NOT NULL AND _s IS NOT NULL")
    return d.groupBy(*keys).agg(F.when(F.count("*") > 10, correlation(F.col("_o"), F.col("_s"))).alias("anomaly_corr"))


def trend(df: DataFrame, keys: list[str], ts: str, col: str) -> DataFrame:
    """Least-squares slope per year; 0 with fewer than 10 points."""
    day = F.datediff(F.col(ts), F.lit("1970-01-01").cast("date")) / 365.25
    return df.groupBy(*keys).agg(F.when(F.count(col) < 10, 0.0).otherwise(F.regr_slope(F.col(col), day)).alias("trend"))


def autocorr(df: DataFrame, keys: list[str], ts: str, col: str, lag: int = 1) -> DataFrame:
    d = df.withColumn("_p", F.lag(col, lag).over(W.partitionBy(*keys).orderBy(ts))).where(F.col("_p").isNotNull() & F.col(col).isNotNull())
    return d.groupBy(*keys).agg(F.when(F.count("*") >= 10, correlation(F.col(col), F.col("_p"))).alias("autocorr"))


def spells(df: DataFrame, keys: list[str], ts: str, cond: Column) -> DataFrame:
    """Runs of consecutive rows that meet the condition (a null does not): their number, mean, median and longest
    length in rows, runs a water year, and skewness and excess kurtosis of the lengths when there are over two."""
    w = W.partitionBy(*keys).orderBy(ts)
    d = df.withColumn("_c", F.coalesce(cond, F.lit(False))).withColumn("_wy", water_year(F.col(ts)))
    years = d.groupBy(*keys).agg(F.countDistinct("_wy").alias("_years"))
    d = d.withColumn("_g", F.row_number().over(w) - F.row_number().over(W.partitionBy(*keys, "_c").orderBy(ts))).where("_c")
    runs = d.groupBy(*keys, "_g").agg(F.count("*").alias("_n"))
    many = F.count("*") > 2
    s = runs.groupBy(*keys).agg(F.count("*").alias("spells"), F.avg("_n").alias("mean_len"), F.median("_n").alias("median_len"), F.max("_n").alias("max_len"), F.when(many, F.skewness("_n")).alias("skew"), F.when(many, F.kurtosis("_n")).alias("kurt"))
    return years.join(s, keys, "left").withColumn("spells", F.coalesce("spells", F.lit(0))).withColumn("per_year", F.col("spells") / F.col("_years")).drop("_years")


def half_flow_day(df: DataFrame, keys: list[str], d: str, col: str) -> DataFrame:
    """Mean and population std over water years of the first day of the year by which over half the flow has passed."""
    y = df.withColumn("_wy", water_year(F.col(d)))
    w = W.partitionBy(*keys, "_wy").orderBy(d)
    y = y.withColumn("_c", F.sum(col).over(w)).withColumn("_t", F.sum(col).over(W.partitionBy(*keys, "_wy"))).where("_t > 0 AND _c / _t > 0.5")
    first = y.groupBy(*keys, "_wy").agg(F.min_by(F.dayofyear(d), d).alias("_d"))
    return first.groupBy(*keys).agg(F.avg("_d").alias("half_flow_mean"), F.stddev_pop("_d").alias("half_flow_std"))


def fdc(df: DataFrame, keys: list[str], col: str, weibull: bool = True) -> DataFrame:
    """Flows in descending order with the percent of time they are exceeded: rank/(n+1), or rank/n."""
    n = F.count("*").over(W.partitionBy(*keys))
    k = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(col).desc()))
    return df.where(F.col(col).isNotNull()).select(*keys, F.col(col).alias("flow"), (100 * k / (n + 1 if weibull else n)).alias("exceedance"))


def fdc_quantiles(df: DataFrame, keys: list[str], col: str, at: tuple[float, ...] = (1, 5, 10, 50, 85, 95, 99)) -> DataFrame:
    """The curve linearly interpolated at fixed exceedances, ends held, and indices of its shape."""
    c = fdc(df, keys, col)
    w = W.partitionBy(*keys).orderBy("exceedance")
    c = c.withColumn("_f", F.lead("flow").over(w)).withColumn("_e", F.lead("exceedance").over(w))
    q = []
    for p in at:
        line = F.max(F.when((F.col("exceedance") <= p) & (F.col("_e") > p), F.col("flow") + (F.col("_f") - F.col("flow")) * (p - F.col("exceedance")) / (F.col("_e") - F.col("exceedance"))))
        q.append(F.coalesce(line, F.when(F.min("exceedance") > p, F.max("flow")).otherwise(F.min("flow"))).alias(f"q{p:g}"))
    d = c.groupBy(*keys).agg(*q)
    return d.withColumn("q10_q50", F.col("q10") / F.col("q50")).withColumn("q50_q95", F.col("q50") / F.col("q95")).withColumn("spread", (F.col("q10") - F.col("q95")) / F.col("q50"))


def fdc_slope(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Slope of the ascending log flows between positions int(.33 n) and int(.66 n); zero flow is a thousandth of the mean."""
    m = F.avg(col).over(W.partitionBy(*keys))
    d = df.withColumn("_l", F.log(F.when(F.col(col) <= 0, 0.001 * m).otherwise(F.col(col))))
    d = d.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy("_l")) - 1).withColumn("_n", F.count("*").over(W.partitionBy(*keys)))
    at = lambda p: F.max(F.when(F.col("_k") == F.floor(F.col("_n") * p), F.col("_l")))
    return d.groupBy(*keys).agg(((at(0.66) - at(0.33)) / 0.33).alias("fdc_slope"))


def flow_percentiles(df: DataFrame, keys: list[str], col: str, at: tuple[int, ...] = (1, 5, 10, 25, 50, 75, 90, 95, 99)) -> DataFrame:
    p = df.groupBy(*keys).agg(F.percentile(col, F.array(*[F.lit(x / 100) for x in at])).alias("_p"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"))
    return p.select(*keys, *[F.col("_p")[i].alias(f"p{x}") for i, x in enumerate(at)], "mean", "std")


def water_balance(df: DataFrame, keys: list[str], d: str, p: str = "p", q: str = "q") -> DataFrame:
    """Annual runoff ratios (mean, std, coefficient of variation), mean P - Q, and flow seasonality of the monthly cycle."""
    year = df.groupBy(*keys, F.year(d).alias("_y")).agg(F.sum(p).alias("_p"), F.sum(q).alias("_q")).where("_p > 0").withColumn("_r", F.col("_q") / F.col("_p"))
    a = year.groupBy(*keys).agg(F.avg("_r").alias("rr_mean"), F.stddev_samp("_r").alias("rr_std"), (F.stddev_samp("_r") / F.avg("_r")).alias("rr_cv"), F.avg(F.col("_p") - F.col("_q")).alias("aet"))
    month = df.groupBy(*keys, F.month(d).alias("_m")).agg(F.avg(p).alias("_p"), F.avg(q).alias("_q"))
    month = month.withColumn("_f", F.col("_q") / F.sum("_q").over(W.partitionBy(*keys)))
    b = month.groupBy(*keys).agg(correlation(F.col("_p"), F.col("_q")).alias("pq_corr"), F.max(F.struct("_q", (-F.col("_m")).alias("k")))["k"].alias("_k"), (0.5 * F.sum(F.abs(F.col("_f") - 1 / 12))).alias("flow_seasonality"))
    return a.join(b, keys).withColumn("peak_month", -F.col("_k")).drop("_k")


def water_indices(df: DataFrame, keys: list[str], d: str, p: str = "p", q: str = "q", pet: str = "pet") -> DataFrame:
    """Of annual sums the mean and standard deviation of P - Q and of PET / P, and the mean of (P - Q) / P; of the months' mean sums the
    least and greatest Q / P, their difference and their months (ties to the first). Days where one of the three is null are left out; so are years and months without P."""
    rows = df.where(F.col(p).isNotNull() & F.col(q).isNotNull() & F.col(pet).isNotNull())
    year = rows.groupBy(*keys, F.year(d).alias("_y")).agg(F.sum(p).alias("_p"), F.sum(q).alias("_q"), F.sum(pet).alias("_e")).where("_p > 0")
    aet, dry = F.col("_p") - F.col("_q"), F.col("_e") / F.col("_p")
    a = year.groupBy(*keys).agg(F.avg(aet).alias("aet_mean"), F.stddev_samp(aet).alias("aet_std"), F.avg(dry).alias("aridity_mean"), F.stddev_samp(dry).alias("aridity_std"), F.avg(aet / F.col("_p")).alias("evaporative_mean"))
    month = rows.groupBy(*keys, F.year(d).alias("_y"), F.month(d).alias("_m")).agg(F.sum(p).alias("_p"), F.sum(q).alias("_q")).groupBy(*keys, "_m").agg(F.avg("_p").alias("_p"), F.avg("_q").alias("_q")).where("_p > 0")
    r = F.col("_q") / F.col("_p")
    b = month.groupBy(*keys).agg(F.min(F.struct(r.alias("r"), F.col("_m").alias("m"))).alias("_lo"), F.max(F.struct(r.alias("r"), (-F.col("_m")).alias("m"))).alias("_hi"))
    return a.join(b, keys).select(*a.columns, F.col("_lo.r").alias("ratio_min"), F.col("_hi.r").alias("ratio_max"), (F.col("_hi.r") - F.col("_lo.r")).alias("ratio_range"), F.col("_lo.m").alias("min_month"), (-F.col("_hi.m")).alias("max_month"))


def precip_seasonality(df: DataFrame, keys: list[str], d: str, p: str = "p") -> DataFrame:
    """Walsh index, and Markham's vector of monthly sums as length and month."""
    m = df.groupBy(*keys, F.month(d).alias("_m")).agg(F.sum(p).alias("_p"))
    m = m.withColumn("_t", F.sum("_p").over(W.partitionBy(*keys))).withColumn("_a", F.radians(30.0 * (F.col("_m") - 1)))
    s = m.groupBy(*keys).agg((F.sum(F.abs(F.col("_p") - F.col("_t") / 12)) / F.max("_t")).alias("walsh"), F.sum(F.col("_p") * F.sin("_a")).alias("_y"), F.sum(F.col("_p") * F.cos("_a")).alias("_x"), F.max("_t").alias("_t"))
    month = F.pmod(F.round(F.degrees(F.atan2("_y", "_x")) / 30), F.lit(12))
    return s.select(*keys, "walsh", (F.sqrt(F.col("_x") ** 2 + F.col("_y") ** 2) / F.col("_t")).alias("markham"), F.when(month == 0, 12).otherwise(month).cast("int").alias("markham_month"))


def sine_fit(df: DataFrame, keys: list[str], d: str, col: str) -> DataFrame:
    """Mean, amplitude and phase of a yearly sine by the normal equations of its sine and cosine."""
    x = 2 * math.pi * (F.dayofyear(d) - 1) / 365
    s, c, v = F.sin(x), F.cos(x), F.col(col)
    a = df.where(v.isNotNull()).groupBy(*keys).agg(F.avg(v).alias("m"), F.covar_pop(s, v).alias("sv"), F.covar_pop(c, v).alias("cv"), F.var_pop(s).alias("ss"), F.var_pop(c).alias("cc"), F.covar_pop(s, c).alias("sc"), F.avg(s).alias("ms"), F.avg(c).alias("mc"))
    det = F.col("ss") * F.col("cc") - F.col("sc") ** 2
    b1, b2 = (F.col("sv") * F.col("cc") - F.col("cv") * F.col("sc")) / det, (F.col("cv") * F.col("ss") - F.col("sv") * F.col("sc")) / det
    return a.select(*keys, (F.col("m") - b1 * F.col("ms") - b2 * F.col("mc")).alias("level"), F.sqrt(b1**2 + b2**2).alias("amplitude"), F.pmod(F.atan2(-b2, b1) / (2 * math.pi), F.lit(1.0)).alias("phase"))


def seasonality_index(df: DataFrame, keys: list[str], d: str, p: str = "p", t: str = "t") -> DataFrame:
    """Relative yearly amplitude of precipitation times the cosine of its lag behind temperature: 1 in phase, -1 against it."""
    a, b = sine_fit(df, keys, d, p), sine_fit(df, keys, d, t).withColumnsRenamed({"level": "_tl", "amplitude": "_ta", "phase": "_tp"})
    index = F.col("amplitude") / F.col("level") * F.signum("_ta") * F.cos(2 * math.pi * (F.col("phase") - F.col("_tp")))
    return a.join(b, keys).select(*keys, index.alias("seasonality"))


def sine_fit_clipped(df: DataFrame, keys: list[str], d: str, col: str) -> DataFrame:
    """level m, amplitude a and phase f of v = max(0, m * (1 + a * sin(2 pi (x - f)))), x = (day of year - 1) / 365, by least squares.

    For a fixed day the error depends on the day's count and sum only, so rows are summed by day first, at most
    366 sums a key, and a key's fit is one small task. With a = tan(b) the model is a height times
    max(0, cos b + sin b * sin(...)), whose best height is linear; the two angles are searched on a grid that
    closes in on its best point. Null values are passed over; a key without any gives no row, one whose best
    height is not positive has amplitude and phase null.
    """
    days = df.where(F.col(col).isNotNull()).groupBy(*keys, F.dayofyear(d).alias("_day")).agg(F.count("*").alias("_n"), F.sum(F.col(col).cast("double")).alias("_s"))
    schema = df.select(*keys).schema.simpleString()[7:-1] + ", level double, amplitude double, phase double"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, n, s = 2 * np.pi * (pdf["_day"].to_numpy() - 1) / 365, pdf["_n"].to_numpy(float), pdf["_s"].to_numpy()
        b, f, wide, best = 0.25 * np.pi, 0.5, 1.0, (0.0, None, None, None)
        while wide > 1e-9:
            bs = np.clip(b + wide * 0.25 * np.pi * np.linspace(-1, 1, 41), 0, 0.5 * np.pi - 1e-6)
            fs = f + wide * 0.5 * np.linspace(-1, 1, 61)
            for at in bs:
                g = np.maximum(0, np.cos(at) + np.sin(at) * np.sin(x[:, None] - 2 * np.pi * fs))
                up, down = s @ g, n @ g**2
                gain = np.where((up > 0) & (down > 0), up**2 / np.where(down > 0, down, 1), 0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = gain[k], up[k] / down[k], at, fs[k]
            if best[1] is None:
                break
            b, f, wide = best[2], best[3], wide / 4
        out = pdf[keys].head(1).copy()
        found = best[1] is not None
        out["level"] = best[1] * np.cos(best[2]) if found else s.sum() / n.sum()
        out["amplitude"] = np.tan(best[2]) if found else np.nan
        out["phase"] = best[3] % 1.0 if found else np.nan
        return out

    out = days.groupBy(*keys).applyInPandas(fit, schema)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("amplitude", "phase")})


def seasonality_index_clipped(df: DataFrame, keys: list[str], d: str, p: str = "p", t: str = "t") -> DataFrame:
    """`seasonality_index` with precipitation that cannot fall below 0."""
    a, b = sine_fit_clipped(df, keys, d, p), sine_fit(df, keys, d, t).select(*keys, F.col("amplitude").alias("_ta"), F.col("phase").alias("_tp"))
    return a.join(b, keys).select(*keys, (F.col("amplitude") * F.signum("_ta") * F.cos(2 * math.pi * (F.col("phase") - F.col("_tp")))).alias("seasonality"))


def _fu(x: Column, w: Column) -> Column:
    return 1 + x - F.pow(1 + F.pow(x, w), 1 / w)


def budyko_w(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Fu's parameter by a grid search from 1.01 to 10 in steps of 0.01 over rows with x, y > 0; the grid is made in place."""
    d = df.where(f"{x} > 0 AND {y} > 0").select(*keys, x, y, F.explode(F.sequence(F.lit(101), F.lit(1000))).alias("_k")).withColumn("w", F.col("_k") / 100)
    e = d.groupBy(*keys, "w").agg(F.avg((_fu(F.col(x), F.col("w")) - F.col(y)) ** 2).alias("_e"))
    return e.groupBy(*keys).agg(F.min(F.struct(F.round("_e", 12), F.col("w"))).alias("_b")).select(*keys, F.col("_b.w").alias("w"))


def budyko_residual(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """w, the ratio it predicts at the mean of x over all rows, and how far the mean of y is above it."""
    mean = df.groupBy(*keys).agg(F.avg(x).alias("_x"), F.avg(y).alias("_y"))
    d = budyko_w(df, keys, x, y).join(mean, keys).withColumn("predicted", _fu(F.col("_x"), F.col("w")))
    return d.select(*keys, "w", "predicted", (F.col("_y") - F.col("predicted")).alias("residual"))


def baseflow_rows(df: DataFrame, keys: list[str], ts: str, col: str, a: float = 0.98, bfi_max: float = 0.8) -> DataFrame:
    """Each row with `base`: Eckhardt's filter b = min(q, ((1-B) a b' + (1-a) B q) / (1 - a B)), from b = q at a key's first value; nulls are passed over.

    The recursion needs a key's rows in order: one gauge's record, not more, is in a task's memory.
    """
    f, g = (1 - bfi_max) * a / (1 - a * bfi_max), (1 - a) * bfi_max / (1 - a * bfi_max)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        q = pdf[col].astype(float).to_numpy()
        out, b = np.full(len(q), np.nan), None
        for k, v in enumerate(q):
            if v == v:
                b = out[k] = v if b is None else min(v, f * b + g * v)
        return pdf.assign(base=out)

    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema)
    out = df.groupBy(*keys).applyInPandas(run, f"{kinds}, base double")
    return out.withColumn("base", F.nanvl("base", F.lit(None).cast("double")))


SEASONS = {"DJF": (12, 1, 2), "MAM": (3, 4, 5), "JJA": (6, 7, 8), "SON": (9, 10, 11)}


def baseflow(df: DataFrame, keys: list[str], ts: str, col: str, a: float = 0.98, bfi_max: float = 0.8, seasonal: bool = False) -> DataFrame:
    """The baseflow index, mean b / mean q, of each key; with `seasonal` a row for each season of it (DJF, MAM, JJA, SON)."""
    d = baseflow_rows(df.select(*keys, ts, col), keys, ts, col, a, bfi_max).where(F.col(col).isNotNull())
    by = list(keys)
    if seasonal:
        name = reduce(lambda x, k: x.when(F.month(ts).isin(*SEASONS[k]), k), SEASONS, F)
        d, by = d.withColumn("season", name), [*keys, "season"]
    return d.groupBy(*by).agg((F.sum("base") / F.nullif(F.sum(F.col(col).cast("double")), F.lit(0.0))).alias("bfi"))


def pet(df: DataFrame, d: str, t: str, latitude: float, method: str = "oudin") -> DataFrame:
    """Potential evapotranspiration in mm a day from day of year and mean temperature in degrees C: oudin (also for
    an unknown name), hamon or hargreaves."""
    j, phi = F.dayofyear(d), math.radians(latitude)
    decl = 0.409 * F.sin(2 * math.pi * j / 365 - 1.39)
    ws = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -math.tan(phi) * F.tan(decl))))
    ra = 24 * 60 / math.pi * 0.0820 * (1 + 0.033 * F.cos(2 * math.pi * j / 365)) * (ws * math.sin(phi) * F.sin(decl) + math.cos(phi) * F.cos(decl) * F.sin(ws))
    c = F.col(t)
    if method == "hamon":
        out = 0.1651 * (ws * 24 / math.pi / 12) * (216.7 * 6.108 * F.exp(17.27 * c / (c + 237.3)) / (c + 273.3))
    elif method == "hargreaves":
        out = 0.0023 * 0.408 * ra * (c + 17.8) * math.sqrt(10)
    else:
        out = 0.408 * ra * (c + 5) / 100
        out = F.when(c > -5, out).otherwise(0.0)
    return df.withColumn("pet", F.greatest(F.lit(0.0), out))


def snow_bucket(df: DataFrame, keys: list[str], ts: str, p: str, t: str, t0: float = 273.15, rate: float = 3.0) -> DataFrame:
    """Snow store: precipitation below t0 accumulates, above it melts at most rate * (T - t0). The store is a running
    sum reflected at zero: S = W - min(0, min W)."""
    w = W.partitionBy(*keys).orderBy(ts)
    step = F.when(F.col(t) < t0, F.col(p)).otherwise(-rate * (F.col(t) - t0))
    d = df.withColumn("_w", F.sum(step).over(w))
    return d.withColumn("swe", F.col("_w") - F.least(F.lit(0.0), F.min("_w").over(w))).drop("_w")


def growing_season(df: DataFrame, keys: list[str], d: str, col: str) -> DataFrame:
    """Months whose mean is at least half way from the least to the greatest month."""
    m = df.groupBy(*keys, F.month(d).alias("_m")).agg(F.avg(col).alias("_v"))
    b = m.groupBy(*keys).agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"), (F.stddev_pop("_v") / F.avg("_v")).alias("variation"))
    on = m.join(b, keys).withColumn("_on", F.col("_v") >= F.col("_a") + 0.5 * (F.col("_b") - F.col("_a")))
    return on.groupBy(*keys).agg(F.count_if("_on").alias("months"), F.min(F.when(F.col("_on"), F.col("_m"))).alias("first_month"), F.max(F.when(F.col("_on"), F.col("_m"))).alias("last_month"), F.min_by("_m", F.struct(-F.col("_v"), F.col("_m"))).alias("peak_month"), (F.max("_v") - F.min("_v")).alias("amplitude"), F.first("variation").alias("variation"))


def sequences(df: DataFrame, keys: list[str], ts: str, features: list[str], target: str, lookback: int, clip: float = 10.0) -> DataFrame:
    """Standardised features of the `lookback` rows before each row, as arrays, with the row's own target."""
    all_, w = W.partitionBy(*keys), W.partitionBy(*keys).orderBy(ts).rowsBetween(-lookback, -1)
    z = lambda c: F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col(c) - F.avg(c).over(all_)) / F.stddev_pop(c).over(all_)))
    d = df.select(*keys, ts, *[z(c).alias(c) for c in dict.fromkeys([*features, target])])
    return d.select(*keys, ts, *[F.collect_list(c).over(w).alias(f"x_{c}") for c in features], F.col(target).alias("y")).where(F.size(f"x_{features[0]}") == lookback)


def thin(df: DataFrame, keys: list[str], ts: str, col: str, most: int) -> DataFrame:
    """Every k-th row so that about `most` a key are left."""
    w = W.partitionBy(*keys)
    k = F.greatest(F.lit(1), F.ceil(F.count("*").over(w) / most))
    return df.withColumn("_k", F.pmod(F.row_number().over(w.orderBy(ts)) - 1, k)).where("_k = 0").drop("_k")


def thin_by_size(df: DataFrame, keys: list[str], ts: str, col: str, most: int = 500, weekly: int = 10_000, daily: int = 1_000) -> DataFrame:
    """A series fit to be drawn: of more than `weekly` rows a key the means of weeks (from Monday), of more than `daily` those of days, then every k-th row."""
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    step = F.when(F.col("_n") > weekly, F.date_trunc("week", ts)).when(F.col("_n") > daily, F.date_trunc("day", ts)).otherwise(F.col(ts).cast("timestamp_ntz"))
    d = df.join(n, keys).groupBy(*keys, step.cast("timestamp_ntz").alias(ts)).agg(F.avg(col).alias(col))
    return thin(d, keys, ts, col, most)


def assemble(series: dict[str, DataFrame], keys: list[str], d: str) -> DataFrame:
    """Daily series (keys, d, value columns) on every day of their common period."""
    names = list(series)
    bounds = None
    for n in names:
        b = series[n].groupBy(*keys).agg(F.min(d).alias(f"a_{n}"), F.max(d).alias(f"b_{n}"))
        bounds = b if bounds is None else bounds.join(b, keys)
    start = F.greatest(*[f"a_{n}" for n in names]) if len(names) > 1 else F.col(f"a_{names[0]}")
    end = F.least(*[f"b_{n}" for n in names]) if len(names) > 1 else F.col(f"b_{names[0]}")
    out = bounds.withColumn("_a", start).withColumn("_b", end).where("_a <= _b").select(*keys, F.explode(F.sequence("_a", "_b", F.expr("INTERVAL 1 DAY"))).alias(d))
    for n in names:
        out = out.join(series[n], [*keys, d], "left")
    return out


def override_forcing(base: DataFrame, supp: DataFrame, keys: list[str], ts: str, col: str) -> DataFrame:
    """Base values replaced by the second source's, interpolated at the base times, where that has any."""
    s = interp_join(base.select(*keys, ts), supp, keys, ts, col).withColumnRenamed(col, "_s")
    return base.join(s, [*keys, ts], "left").withColumn(col, F.coalesce("_s", col)).drop("_s")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], span: tuple[str, str] = ("start", "end"), other: tuple[str, str] = ("from", "to")) -> DataFrame:
    """Rows whose closed intervals overlap, with equal keys: left's columns and right's others.

    Both sides are dealt to the months that they touch and meet in an equi-join; a pair that meets in several months
    counts in the first both have. Intervals without a start or end, or that end before they start, match nothing.
    """
    first = lambda c: F.date_trunc("month", F.col(c).cast("timestamp_ntz"))
    months = lambda d, a, b: d.where(F.col(a) <= F.col(b)).withColumn("_m", F.explode(F.sequence(first(a), first(b), F.expr("INTERVAL 1 MONTH"))))
    (a, b), (c, e) = span, other
    j = months(left, a, b).join(months(right, c, e), [*keys, "_m"])
    return j.where((F.col(a) <= F.col(e)) & (F.col(c) <= F.col(b)) & (F.col("_m") == F.greatest(first(a), first(c)))).drop("_m")


# The second source's variables and, for each, the names under which a forcing table may hold it.
SECOND_SOURCE = {
    "prcp": ["pptrate", "pcp", "precipitation", "PRCP", "prcp"],
    "prcp_corrected": ["pptrate", "pcp", "precipitation", "PRCP", "prcp"],
    "tmean": ["airtemp", "tmp", "temperature", "TEMP", "tmean", "tas"],
}


def second_source_unit(name: str, value: Column, unit: str) -> Column:
    """The second source's precipitation (mm/h) or temperature (Celsius) in the forcing's unit.

    A rate "m s-1" is looked for before "mm s-1", which holds it too and is thus taken for metres; "mm/s" is not.
    Precipitation in another unit stays in mm/h.
    """
    if name == "tmean":
        return value + 273.15 if "K" in unit and "celsius" not in unit.lower() else value
    if "kg m-2 s-1" in unit or "kg m**-2 s**-1" in unit or ("m s-1" not in unit and "mm/s" in unit):
        return value / 3600
    return value / 3_600_000 if "m s-1" in unit else value


def override_from_files(base: DataFrame, files: DataFrame, supp: DataFrame, keys: list[str], ts: str, units: dict[str, str], file: str = "file") -> DataFrame:
    """Forcing whose precipitation and temperature come from a second source where that has them.

    files (keys, file, from, to) lists the second source's month files; those that overlap a base series' record are
    read from supp (keys, file, ts, variables of SECOND_SOURCE). Each variable is interpolated to the base times, put
    into the unit of the first base column that can hold it, and replaces it; variables and columns that are missing are let be.
    """
    record = base.groupBy(*keys).agg(F.min(ts).alias("start"), F.max(ts).alias("end"))
    wanted = overlap_join(record, files.select(*keys, file, "from", "to"), keys).select(*keys, file).distinct()
    rows, out = supp.join(wanted, [*keys, file], "left_semi"), base
    for name, targets in SECOND_SOURCE.items():
        target = next((t for t in targets if t in base.columns), None)
        if name not in supp.columns or target is None:
            continue
        value = second_source_unit(name, F.col(name).cast("double"), units.get(target, ""))
        out = override_forcing(out, rows.select(*keys, ts, value.alias(target)), keys, ts, target)
    return out.select(*base.columns)


def to_naive_local(ts: Column, zone: str) -> Column:
    """UTC wall time to the zone's wall time, without a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))


def to_naive_utc(ts: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), ts.cast("timestamp_ntz"))
