"""Where users put their own code: statistics inside zonal aggregation, evaluation targets, functions of one unit's series."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import align


def custom_stats(joined: DataFrame, keys: list[str], col: str, stats: dict[str, Callable[[pd.Series], float]]) -> DataFrame:
    """One column a statistic; each function gets all non-null values of a unit (so a unit must fit into a task)."""
    def udaf(fn):
        def run(v: pd.Series) -> float:
            return float(fn(v))

        return F.pandas_udf(run, "double")

    return joined.where(F.col(col).isNotNull()).groupBy(*keys).agg(*[udaf(f)(F.col(col).cast("double")).alias(n) for n, f in stats.items()])


def per_unit(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A function of one unit's rows for every unit."""
    return df.groupBy(*keys).applyInPandas(fn, schema)


@dataclass
class Target:
    """An evaluation target: how to read observations and simulation as (keys, value), and which metrics to take."""

    observed: Callable[[DataFrame], DataFrame]
    simulated: Callable[[DataFrame], DataFrame]
    keys: list[str]
    metrics: Callable[[], list[Column]]


TARGETS: dict[str, Target] = {}


def register_target(name: str, target: Target) -> None:
    TARGETS[name] = target


def evaluate(name: str, observed: DataFrame, simulated: DataFrame, by: list[str]) -> DataFrame:
    t = TARGETS[name]
    pairs = align(t.observed(observed), t.simulated(simulated), t.keys, "value", "value")
    return pairs.groupBy(*by).agg(*t.metrics())
