"""Nested layers as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cumulative(depths: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(depths)), lambda i: F.aggregate(F.slice(depths, F.lit(1), i), F.lit(0.0), lambda a, x: a + x))


def nearest_layer(depths: Column, target: float) -> Column:
    """Index from 0 of the layer whose middle is nearest to the depth, the first of tied ones."""
    mid = F.zip_with(cumulative(depths), depths, lambda c, d: F.abs(c - d / 2 - target))
    return F.array_position(mid, F.array_min(mid)) - 1


def rootzone_mean(values: Column, depths: Column, depth: float = 1.0) -> Column:
    """Plain mean of the layers that end within the depth, or of the first."""
    inside = F.zip_with(values, cumulative(depths), lambda v, c: F.when(c <= depth, v))
    v = F.filter(inside, lambda x: x.isNotNull())
    return F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)).otherwise(F.element_at(values, 1))


def water_table(values: Column, depths: Column, saturation: float = 0.8) -> Column:
    """Deepest end of a saturated layer, else the total depth."""
    c = cumulative(depths)
    wet = F.filter(F.zip_with(values, c, lambda v, d: F.when(v >= saturation, d)), lambda x: x.isNotNull())
    return F.coalesce(F.array_max(wet), F.array_max(c))


def rescale_depths(depths: Column, factor: float, shape: float) -> Column:
    """Depths times factor times exponential weights whose mean is 1."""
    w = F.transform(F.sequence(F.lit(0), F.size(depths) - 1), lambda i: F.exp(shape * i / F.greatest(F.lit(1), F.size(depths) - 1)))
    mean = F.aggregate(w, F.lit(0.0), lambda a, x: a + x) / F.size(depths)
    return F.zip_with(depths, w, lambda d, x: d * factor * x / mean)


def sum_components(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Sum of the components that are there; a null in one makes it null."""
    there = [F.col(c) for c in columns if c in df.columns]
    if not there:
        raise ValueError("no component is there")
    return df.withColumn(name, sum(there[1:], there[0]))


def snow_cover(ground: Column, swe: Column) -> Column:
    return F.coalesce(ground, (swe > 1).cast("double"))


def closest_column(columns: list[str], target: float) -> str | None:
    """Of columns named sm_<depth>_... the one of nearest depth."""
    found = [(abs(float(p[1]) - target), c) for c in columns if (p := c.split("_"))[0] == "sm" and len(p) > 1 and p[1].replace(".", "", 1).isdigit()]
    return min(found)[1] if found else None
