"""Arrays of chunks: unnesting, counts, weighted means and fixed windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import percentile


def dbfs(rms: Column) -> Column:
    """Level in decibels of full scale, with a floor of 1e-12."""
    return 20.0 * F.log10(F.greatest(rms, F.lit(1e-12)))


def chunk_audit(rows: DataFrame, key: str, chunks: str, least_finite: int = 4) -> DataFrame:
    """One row for each item: chunks, finite ones, levels' least, median and largest, and
    whether enough chunks are finite. ``chunks`` is an array of (rms, prob)."""
    flat = rows.select(key, F.explode_outer(chunks).alias("c"))
    finite = F.col("c.prob").isNotNull() & ~F.isnan("c.prob")
    level = dbfs(F.col("c.rms"))
    out = flat.groupBy(key).agg(
        F.count("c").alias("n_chunks"), F.count_if(finite).alias("n_finite"), F.min(level).alias("min_dbfs"), percentile(level, 0.5).alias("median_dbfs"),
        F.max(level).alias("max_dbfs"), percentile(F.when(finite, F.col("c.prob")), 0.5).alias("median_prob"),
    )
    return out.withColumn("enough", F.col("n_finite") >= least_finite)


def weighted_probability(prob: Column, rms: Column) -> Column:
    """Aggregate: mean of chunk probabilities by level."""
    return F.sum(prob * rms) / (F.sum(rms) + 1e-9)


def windows(signal: Column, width: int, most: int, least_share: float = 0.5) -> Column:
    """Windows of ``width`` from the first ``most`` elements; a tail under the share is
    dropped, a longer one is padded with zeros."""
    used = F.slice(signal, 1, most)
    n = F.size(used)
    count = F.floor((n + width * (1 - least_share)) / width).cast("int")
    at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.transform(F.sequence(i * width + 1, i * width + width), lambda j: F.coalesce(F.get(used, j - 1), F.lit(0.0))))


def even_starts(length: Column, width: int, count: int = 7) -> Column:
    """Starts of ``count`` evenly spaced windows over a signal."""
    room = F.greatest(length - width, F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * room / F.lit(count - 1)).cast("long"))


def two_class_probability(other: Column, own: Column) -> Column:
    """Softmax of two logits; null unless both are finite."""
    def ok(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    return F.when(ok(own) & ok(other), 1 / (1 + F.exp(other - own)))
