"""Skill metrics of simulated against observed series, by any keys, as grouped aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def align(obs: DataFrame, sim: DataFrame, keys: list[str], obs_col: str = "q", sim_col: str = "q", positive_only: bool = False, least: int = 0) -> DataFrame:
    """keys, obs, sim of the rows both have, without nulls; positive_only drops pairs that are not positive and, with
    `least`, groups (all keys but the last) of fewer pairs."""
    a = obs.select(*keys, F.col(obs_col).cast("double").alias("obs"))
    b = sim.select(*keys, F.col(sim_col).cast("double").alias("sim"))
    out = a.join(b, keys).dropna(subset=["obs", "sim"])
    if positive_only:
        out = out.where("obs > 0 AND sim > 0")
    if least:
        out = out.withColumn("_n", F.count("*").over(W.partitionBy(*keys[:-1]))).where(F.col("_n") >= least).drop("_n")
    return out


def power_transform(pairs: DataFrame, t: float, keys: list[str]) -> DataFrame:
    """obs and sim to the power t; for t < 0 a hundredth of the mean observation is added before."""
    if t >= 0:
        return pairs.withColumn("obs", F.pow("obs", F.lit(t))).withColumn("sim", F.pow("sim", F.lit(t)))
    eps = pairs.groupBy(*keys).agg((F.avg("obs") / 100).alias("_eps"))
    return pairs.join(eps, keys).withColumn("obs", F.pow(F.col("obs") + F.col("_eps"), F.lit(t))).withColumn("sim", F.pow(F.col("sim") + F.col("_eps"), F.lit(t))).drop("_eps")


def _over(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def _pair() -> tuple[Column, Column]:
    return F.col("obs"), F.col("sim")


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation; null where either side does not vary."""
    return _over(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def nse() -> Column:
    O, S = _pair()
    return (1 - _over(F.sum((S - O) ** 2), F.var_pop(O) * F.count(O))).alias("nse")


def nse_simref() -> Column:
    """The denominator is about the mean of the simulation."""
    O, S = _pair()
    about = F.sum(O * O) - 2 * F.avg(S) * F.sum(O) + F.count(O) * F.avg(S) ** 2
    return (1 - _over(F.sum((S - O) ** 2), about)).alias("nse_simref")


def kge() -> Column:
    O, S = _pair()
    return (1 - F.sqrt((correlation(S, O) - 1) ** 2 + (_over(F.stddev_samp(S), F.stddev_samp(O)) - 1) ** 2 + (_over(F.avg(S), F.avg(O)) - 1) ** 2)).alias("kge")


def kge_prime() -> Column:
    O, S = _pair()
    cv = lambda c: _over(F.stddev_samp(c), F.avg(c))
    return (1 - F.sqrt((correlation(S, O) - 1) ** 2 + (_over(cv(S), cv(O)) - 1) ** 2 + (_over(F.avg(S), F.avg(O)) - 1) ** 2)).alias("kge_prime")


def errors() -> list[Column]:
    O, S = _pair()
    return [F.sqrt(F.avg((S - O) ** 2)).alias("rmse"), F.avg((S - O) ** 2).alias("mse"), F.avg(F.abs(S - O)).alias("mae")]


def bias_suite() -> list[Column]:
    O, S = _pair()
    return [
        (100 * _over(F.sum(S) - F.sum(O), F.sum(O))).alias("pbias"), (F.avg(S) - F.avg(O)).alias("bias"), (100 * (F.avg(S) - F.avg(O)) / (F.avg(O) + 1e-9)).alias("bias_pct"),
        correlation(S, O).alias("r"), _over(F.stddev_samp(S), F.stddev_samp(O)).alias("alpha"), _over(F.avg(S), F.avg(O)).alias("beta"),
    ]


def metrics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Every moment-based metric by keys: one shuffle, partial sums inside the tasks."""
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"), nse(), nse_simref(), kge(), kge_prime(), *errors(), *bias_suite())


def label_periods(df: DataFrame, ts: str, periods: dict[str, tuple[str, str]]) -> DataFrame:
    """A row for each period, inclusive at both ends, that holds the row; without periods the label is empty."""
    if not periods:
        return df.withColumn("period", F.lit(""))
    labels = [F.when(F.col(ts).between(F.lit(a).cast(df.schema[ts].dataType), F.lit(b).cast(df.schema[ts].dataType)), F.lit(k)) for k, (a, b) in periods.items()]
    return df.withColumn("period", F.explode(F.array_compact(F.array(*labels))))


def average_rank(col: str, keys: list[str]) -> Column:
    """Rank from 1, ties sharing the mean of theirs."""
    return F.rank().over(W.partitionBy(*keys).orderBy(col)) + (F.count("*").over(W.partitionBy(*keys, col)) - 1) / 2


def kge_np(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Non-parametric KGE: flow-duration variability, mean ratio and Spearman correlation."""
    O, S = _pair()
    all_ = W.partitionBy(*keys)
    p = pairs.withColumn("_ro", average_rank("obs", keys)).withColumn("_rs", average_rank("sim", keys))
    rank = p.groupBy(*keys).agg(correlation(F.col("_ro"), F.col("_rs")).alias("_r"), _over(F.avg(S), F.avg(O)).alias("_b"))
    share = lambda c: pairs.select(*keys, F.row_number().over(W.partitionBy(*keys).orderBy(c)).alias("_k"), (F.col(c) / F.sum(c).over(all_)).alias(f"_{c}"))
    alpha = share("obs").join(share("sim"), [*keys, "_k"]).groupBy(*keys).agg((1 - 0.5 * F.sum(F.abs(F.col("_sim") - F.col("_obs")))).alias("_a"))
    return rank.join(alpha, keys).select(*keys, (1 - F.sqrt((F.col("_a") - 1) ** 2 + (F.col("_b") - 1) ** 2 + (F.col("_r") - 1) ** 2)).alias("kge_np"))


def contingency(pairs: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    O, S = _pair()
    o, s = O > threshold, S > threshold
    n = lambda c: F.count_if(c)
    hit, miss, false, none = n(o & s), n(o & ~s), n(~o & s), n(~o & ~s)
    return pairs.groupBy(*keys).agg(_over(hit, hit + miss).alias("pod"), _over(false, hit + false).alias("far"), _over(hit, hit + miss + false).alias("csi"), _over(hit + none, F.count("*")).alias("accuracy"))


def peak_error(pairs: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Days between the peaks (earliest of tied ones), their signed difference, and the peaks' relative error."""
    day = F.datediff(F.col(ts), F.lit("1970-01-01").cast("date"))
    peak = lambda c: F.max(F.struct(F.col(c).alias("v"), (-day).alias("t")))
    p = pairs.groupBy(*keys).agg(peak("obs").alias("o"), peak("sim").alias("s"))
    shift = F.col("o.t") - F.col("s.t")
    return p.select(*keys, F.abs(shift).alias("peak_days"), shift.alias("peak_shift"), (100 * F.abs(_over(F.col("s.v") - F.col("o.v"), F.col("o.v")))).alias("peak_pct"))


def conditional_bias(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean simulated less observed, in percent of observed, where flow is high (q90), low (q10), wet or dry (median)."""
    O, S = _pair()
    q = pairs.groupBy(*keys).agg(F.percentile("obs", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("_q"))
    part = lambda c: 100 * _over(F.avg(F.when(c, S - O)), F.avg(F.when(c, O)))
    return pairs.join(q, keys).groupBy(*keys).agg(part(O >= F.col("_q")[2]).alias("high_bias"), part(O <= F.col("_q")[0]).alias("low_bias"), part(O >= F.col("_q")[1]).alias("wet_bias"), part(O < F.col("_q")[1]).alias("dry_bias"))


def range_metrics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    O, S = _pair()
    ratio = _over(F.max(S) - F.min(S), F.max(O) - F.min(O))
    return pairs.groupBy(*keys).agg(ratio.alias("range_ratio"), ((ratio - 1) * 100).alias("range_bias"))


def pair_report(obs: DataFrame, sim: DataFrame, keys: list[str], ts: str, col: str = "q") -> DataFrame:
    """Counts, moments and flags of two series, and how much of the shorter one they share."""
    side = lambda d, n: d.groupBy(*keys).agg(F.count(col).alias(f"n_{n}"), F.min(col).alias(f"min_{n}"), F.max(col).alias(f"max_{n}"), F.avg(col).alias(f"mean_{n}"), F.stddev_samp(col).alias(f"std_{n}"), F.median(col).alias(f"median_{n}"), F.avg((F.col(col) == 0).cast("double")).alias(f"zero_{n}"))
    both = align(obs, sim, [*keys, ts], col, col).groupBy(*keys).agg(F.count("*").alias("n_both"), correlation(F.col("obs"), F.col("sim")).alias("r"))
    d = reduce(lambda a, b: a.join(b, keys, "left"), [side(obs, "obs"), side(sim, "sim"), both])
    d = d.withColumn("mean_ratio", _over(F.col("mean_sim"), F.col("mean_obs"))).withColumn("overlap_pct", 100 * F.coalesce("n_both", F.lit(0)) / F.least("n_obs", "n_sim"))
    flag = (F.col("mean_ratio") < 0.01) | (F.col("mean_ratio") > 100) | F.coalesce(F.col("r") < -0.5, F.lit(False)) | (F.col("zero_obs") > 0.8) | (F.col("zero_sim") > 0.8)
    return d.withColumn("flagged", flag)
