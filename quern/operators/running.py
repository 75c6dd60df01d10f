"""Running totals that scale: bands first, then rows inside a band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage

BANDS = 1024


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the place of each row, from 0, in an order over the whole table.

    Rows are dealt to ranges of the order and sorted inside them; a range's first place is the
    number of rows in the ranges before, of which there are as many as shuffle partitions.
    """
    keys = [f"_order{i}" for i in range(len(order))]
    ranged = rows.withColumns(dict(zip(keys, order))).repartitionByRange(*keys)
    ranged = stage(ranged.withColumn("_part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1
    placed = ranged.withColumn("_in", inside).join(F.broadcast(first), "_part")  # a row for each range
    return placed.withColumn(name, F.col("_first") + F.col("_in")).drop("_part", "_in", "_first", *keys)


def from_the_top(df: DataFrame, groups: list[str], value: str, sums: list[str], bands: int = BANDS) -> DataFrame:
    """Adds ``cum_<s>``: the sum of ``s`` over rows of the group with a value at least this
    row's. ``value`` lies in [0, 1] and is distinct inside a group.

    Values are cut into bands; a band's offset comes from a window over the few band totals,
    and rows are summed inside (group, band), so that no task sees a whole group.
    """
    band = F.least(F.floor(F.col(value) * bands), F.lit(bands - 1))
    banded = df.withColumn("_band", band)
    totals = banded.groupBy(*groups, "_band").agg(*[F.sum(s).alias(s) for s in sums])
    above = Window.partitionBy(*groups).orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*groups, "_band", *[F.coalesce(F.sum(s).over(above), F.lit(0)).alias(f"_off_{s}") for s in sums])
    inside = Window.partitionBy(*groups, "_band").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    same: Column = F.col("a._band") == F.col("b._band")
    for g in groups:
        same = same & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    run = banded.select("*", *[F.sum(s).over(inside).alias(f"_in_{s}") for s in sums])
    joined = run.alias("a").join(offsets.alias("b"), same)
    return joined.select(*[F.col(f"a.{c}") for c in df.columns], *[(F.col(f"a._in_{s}") + F.col(f"b._off_{s}")).alias(f"cum_{s}") for s in sums])
