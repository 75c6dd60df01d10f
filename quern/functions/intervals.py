"""Ratios and binomial intervals as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Normal quantiles of the two interval forms in use (fixed values).
Z_SHORT = 1.959964
Z_LONG = 1.959963984540054


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, null where ``b`` is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def wilson(k: Column, n: Column, z: float = Z_SHORT) -> tuple[Column, Column]:
    """Lower and upper Wilson bound, held in [0, 1]; null for an empty group."""
    k, n = k.cast("double"), n.cast("double")
    p = F.try_divide(k, n)
    den = 1 + F.try_divide(F.lit(z * z), n)
    centre = (p + F.try_divide(F.lit(z * z), 2 * n)) / den
    half = F.lit(z) * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n)) / den
    some = n > 0
    return F.when(some, F.greatest(F.lit(0.0), centre - half)), F.when(some, F.least(F.lit(1.0), centre + half))


def f1_clamped(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 with denominators clamped, so that empty classes give 0 instead of null."""
    precision = tp / F.greatest(tp + fp, F.lit(1))
    recall = tp / F.greatest(tp + fn, F.lit(1))
    return 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))


def f1_zero(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 that is 0 where it is undefined."""
    return F.coalesce(F.try_divide(2.0 * tp, (2 * tp + fp + fn).cast("double")), F.lit(0.0))


def percentile(x: Column, at: float) -> Column:
    """Aggregate: exact percentile with linear interpolation."""
    return F.percentile(x, F.lit(at))


def upper_median(name: str) -> Column:
    """Aggregate: of an even count the larger of the two middle values. The discrete median
    of the negated values; Spark merges its value counts in parts."""
    return -F.expr(f"percentile_disc(0.5) within group (order by -{name})")
