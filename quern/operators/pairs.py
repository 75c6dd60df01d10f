"""Paired views of one item: ranges, shifts, flips and four-view contrasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import percentile


def view_table(rows: DataFrame, case: list[str], view: str, value: str, views: list[str]) -> DataFrame:
    """One row for each case, one column for each view; null where a view has no value."""
    return rows.groupBy(*case).pivot(view, views).agg(F.first(value, ignorenulls=True))


def view_range(table: DataFrame, views: list[str]) -> DataFrame:
    """Largest less smallest value, null unless all views have one."""
    whole = F.forall(F.array(*[F.col(v) for v in views]), lambda x: x.isNotNull())
    return table.withColumn("range", F.when(whole, F.greatest(*views) - F.least(*views)))


def range_statistics(ranges: DataFrame, value: str = "range") -> DataFrame:
    return ranges.agg(
        F.count(F.lit(1)).alias("attempted"), F.count(value).alias("complete"), F.avg(value).alias("mean"),
        percentile(F.col(value), 0.5).alias("median"), F.max(value).alias("max"), percentile(F.col(value), 0.9).alias("p90"),
    )


def pair_columns(first: str, second: str, cut: float = 0.5) -> list[Column]:
    """``shift, abs_shift, flip``: null unless both views have a value."""
    a, b = F.col(first), F.col(second)
    both = a.isNotNull() & b.isNotNull()
    return [F.when(both, b - a).alias("shift"), F.when(both, F.abs(b - a)).alias("abs_shift"), F.when(both, ((a >= cut) != (b >= cut)).cast("double")).alias("flip")]


def pair_summary(table: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Attempted and complete cases, mean shifts, flip rate and flips (null without a pair)."""
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), *pair_columns(a, b)) for a, b in pairs]))
    out = table.select(rows.alias("p")).select("p.*").groupBy("first", "second").agg(
        F.count(F.lit(1)).alias("attempted"), F.count("shift").alias("complete"), F.avg("shift").alias("signed_shift"),
        F.avg("abs_shift").alias("absolute_shift"), F.avg("flip").alias("flip_rate"), F.sum("flip").cast("long").alias("flips"),
    )
    return out


def interaction(table: DataFrame, base: str, staged: str, coded: str, coded_staged: str) -> DataFrame:
    """(coded_staged - staged) - (coded - base) of each case; null if any view is."""
    value = (F.col(coded_staged) - F.col(staged)) - (F.col(coded) - F.col(base))
    return table.withColumn("interaction", value)


def repeat_differences(rows: DataFrame, kind: str, difference: str) -> DataFrame:
    return rows.where(F.col(difference).isNotNull()).groupBy(kind).agg(F.count(F.lit(1)).alias("comparable"), F.max(F.abs(difference)).alias("max_abs_difference"))
