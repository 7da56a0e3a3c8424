"""Rates and their Wilson intervals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(cleared: Column, n: Column) -> Column:
    return F.coalesce(F.try_divide(cleared.cast("double"), n.cast("double")), F.lit(0.0))


def wilson(cleared: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound, clamped to [0, 1]; (0, 0) without trials."""
    m = F.when(n > 0, n.cast("double")).otherwise(F.lit(1.0))
    p = cleared.cast("double") / m
    zz = F.lit(z) * F.lit(z)
    denominator = F.lit(1.0) + zz / m
    centre = (p + zz / (F.lit(2.0) * m)) / denominator
    half = (F.lit(z) * F.sqrt((p * (F.lit(1.0) - p) + zz / (F.lit(4.0) * m)) / m)) / denominator
    low, high = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    return F.when(n > 0, low).otherwise(F.lit(0.0)), F.when(n > 0, high).otherwise(F.lit(0.0))


def clamped(score: Column, default: Column) -> Column:
    """A score as text to [0, 1]; the default where it isn't a number."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(score.try_cast("double"), default)))
