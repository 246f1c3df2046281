"""Set operations over keys, sorting and top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def common_keys(dfs: list[DataFrame], keys: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.intersect(b), [d.select(*keys) for d in dfs])


def missing_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of a that b lacks."""
    return a.select(*keys).subtract(b.select(*keys))


def sort_units(df: DataFrame, order: list[Column | str]) -> DataFrame:
    return df.orderBy(*order)


def top_k(df: DataFrame, order: list[Column | str], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def inconsistent_keys(dfs: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys that not all tables have once: with the number of rows in each; no row means consistent."""
    counts = [d.groupBy(key).agg(F.count("*").alias(n)) for n, d in dfs.items()]
    d = reduce(lambda a, b: a.join(b, key, "full"), counts).fillna(0, list(dfs))
    return d.where(reduce(lambda a, b: a | b, [F.col(n) != 1 for n in dfs]))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], mode: str = "full") -> DataFrame:
    """Rows of both by key, the new table's values where it has any; `left` keeps the existing rows only."""
    shared = [c for c in existing.columns if c in new.columns and c not in keys]
    fresh = new.withColumnsRenamed({c: f"_{c}" for c in shared})
    d = existing.join(fresh, keys, mode)
    return d.withColumns({c: F.coalesce(f"_{c}", c) for c in shared}).drop(*[f"_{c}" for c in shared])


def known_units(df: DataFrame, units: DataFrame, unit: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose unit is among `units`, and the report of units that are not. None left is an error."""
    own = units.select(unit).distinct()
    kept, missing = df.join(own, unit, "left_semi"), df.select(unit).distinct().join(own, unit, "left_anti")
    if kept.isEmpty():
        raise ValueError(f"no row has a known {unit}")
    return kept, missing


def mask_union(masks: list[DataFrame], cell: str) -> DataFrame:
    """Cells that any of the masks has, each once."""
    return reduce(lambda a, b: a.unionByName(b), [m.select(cell) for m in masks]).distinct()
