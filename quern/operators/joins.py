"""Joins, set comparisons and the checks that belong to them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_unknown(left: DataFrame, right: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """The inner join, and the left rows whose key the right side lacks."""
    return left.join(right, on), left.join(right, on, "left_anti")


def missing_rows(manifest: DataFrame, scores: DataFrame, on: str) -> DataFrame:
    return manifest.join(scores, on, "left_anti")


def common_keys(scores: DataFrame, key: str, model: str, models: int) -> DataFrame:
    """Keys that every one of ``models`` models scored."""
    return scores.groupBy(key).agg(F.count_distinct(model).alias("n")).where(F.col("n") == models).select(key)


def compare_tables(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``(key, side, fields)``: left_only, right_only, conflict (with the differing fields) or equal."""
    a = left.select(F.col(key).alias("key"), F.struct(*fields).alias("l"))
    b = right.select(F.col(key).alias("k2"), F.struct(*fields).alias("r"))
    both = a.join(b, F.col("key") == F.col("k2"), "full_outer")
    differ = F.array_compact(F.array(*[F.when(~F.col("l")[f].eqNullSafe(F.col("r")[f]), F.lit(f)) for f in fields]))
    side = F.when(F.col("k2").isNull(), "left_only").when(F.col("key").isNull(), "right_only").when(F.size(differ) > 0, "conflict").otherwise("equal")
    return both.select(F.coalesce("key", "k2").alias("key"), side.alias("side"), F.when(side == "conflict", F.array_join(differ, ",")).otherwise("").alias("fields"))


def three_way(rows: DataFrame, lines: DataFrame, on: str) -> DataFrame:
    """Adds ``matched``: both, row_only or line_only. A key that repeats among the lines is an error."""
    n = lines.groupBy(on).agg(F.count(F.lit(1)).alias("_n"))
    once = lines.join(n, on).withColumn(on, F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate line: "), F.col(on).cast("string")))).otherwise(F.col(on))).drop("_n")
    a, b = rows.withColumn("_a", F.lit(True)), once.withColumn("_b", F.lit(True))
    both = a.join(b, on, "full_outer")
    return both.withColumn("matched", F.when(F.col("_b").isNull(), "row_only").when(F.col("_a").isNull(), "line_only").otherwise("both")).drop("_a", "_b")


def content_match(files: DataFrame, manifest: DataFrame, digest: str, path: str, key: str) -> DataFrame:
    """Manifest rows with the first path of their content and the number of copies."""
    paths = files.groupBy(digest).agg(F.min(path).alias("bound_path"), F.count(F.lit(1)).alias("copies"))
    return manifest.join(paths, digest, "left").select(key, digest, "bound_path", F.coalesce("copies", F.lit(0).cast("long")).alias("copies"))


def unique_lookup(rows: DataFrame, keys: list[str], value: str, source: Column, target: Column, unknown: str = "unknown") -> DataFrame:
    """Target rows borrow the value of the source rows with equal keys if it is one value."""
    known = rows.where(source).groupBy(*keys).agg(F.when(F.count_distinct(value) == 1, F.min(value)).alias("_one"))
    joined = rows.join(known, keys, "left")
    return joined.withColumn(value, F.when(target, F.coalesce("_one", F.lit(unknown))).otherwise(F.col(value))).drop("_one")


def restricted(rows: DataFrame, ids: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """The rows of a cohort, and cohort ids that have no row."""
    return rows.join(ids, on, "left_semi"), ids.join(rows, on, "left_anti")


def override(base: DataFrame, better: DataFrame, on: str, value: str) -> DataFrame:
    """Values of ``better`` where it has them, else of ``base``; keys of either."""
    a = base.select(on, F.col(value).alias("_base"))
    b = better.select(on, F.col(value).alias("_better"))
    return a.join(b, on, "full_outer").select(on, F.coalesce("_better", "_base").alias(value), F.col("_better").isNotNull().alias("recovered"))


def merge_shards(members: DataFrame, shards: list[DataFrame], on: str) -> DataFrame:
    """``(key, n, status)`` of all members and shard rows: ok, missing, duplicate or extra."""
    rows = reduce(DataFrame.unionByName, shards).groupBy(F.col(on).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    both = members.select(F.col(on).alias("m")).distinct().join(rows, F.col("m") == F.col("key"), "full_outer")
    status = F.when(F.col("m").isNull(), "extra").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").otherwise("ok")
    return both.select(F.coalesce("m", "key").alias("key"), F.coalesce("n", F.lit(0).cast("long")).alias("n"), status.alias("status"))


def exact_cover(cohort: DataFrame, scored: DataFrame, failed: DataFrame, on: str) -> DataFrame:
    """``(problem, n)``: cohort rows in neither or both sets, and rows outside the cohort."""
    flags = cohort.select(on).distinct().withColumn("c", F.lit(1))
    flags = flags.join(scored.select(on).distinct().withColumn("s", F.lit(1)), on, "full_outer").join(failed.select(on).distinct().withColumn("f", F.lit(1)), on, "full_outer")
    problem = (
        F.when(F.col("c").isNull(), "outside_cohort").when(F.col("s").isNotNull() & F.col("f").isNotNull(), "scored_and_failed")
        .when(F.col("s").isNull() & F.col("f").isNull(), "neither")
    )
    return flags.select(problem.alias("problem")).where("problem is not null").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def set_difference(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """``(part, n)``: left_only, right_only and common distinct keys."""
    a, b = left.select(on).distinct(), right.select(on).distinct()
    tagged = a.withColumn("s", F.lit(1)).unionByName(b.withColumn("s", F.lit(2))).groupBy(on).agg(F.sum("s").alias("s"))
    part = F.when(F.col("s") == 1, "left_only").when(F.col("s") == 2, "right_only").otherwise("common")
    return tagged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))


def unique_union(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """All parts one after the other, columns by name; a repeated key is an error."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return rows.withColumn(keys[0], F.when(n > 1, F.raise_error(F.concat(F.lit("repeated key: "), F.concat_ws(":", *keys)))).otherwise(F.col(keys[0])))


def reason_union(*columns: str) -> Column:
    return F.array_sort(reduce(F.array_union, [F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns]))


def preferred_match(rows: DataFrame, links: DataFrame, on: str, owner: str, order: list[str]) -> DataFrame:
    """The link of each owner's rows that is first in the order of preference."""
    rank = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        rank = F.when(F.col("name") == name, i).otherwise(rank)
    matched = rows.join(links, [on, owner]).withColumn("_p", rank)
    first = F.row_number().over(Window.partitionBy(owner).orderBy("_p", on))
    return matched.withColumn("_f", first).where("_f = 1").drop("_p", "_f")


def of_values(rows: DataFrame, column: str, allowed: list) -> DataFrame:
    """Rows whose value is in a list; null is not."""
    return rows.where(F.col(column).isin(*allowed))


def disjoint(rows: DataFrame, held: DataFrame, *keys: str) -> DataFrame:
    """Rows that share none of the keys with any held row."""
    return reduce(lambda left, k: left.join(held.select(k).distinct(), k, "left_anti"), keys, rows)


def common_pairs(first: DataFrame, second: DataFrame, on: str, value: str = "prob") -> DataFrame:
    """Rows that both models scored, with ``value`` of the first and ``other`` of the second."""
    other = second.where(F.col(value).isNotNull()).select(on, F.col(value).alias("other"))
    return first.where(F.col(value).isNotNull()).join(other, on)


def stem_matches(rows: DataFrame, training: DataFrame, stem: str, allowed) -> DataFrame:
    """Rows and training rows of one stem, but for pairs that ``allowed`` excuses."""
    return rows.join(training, stem).where(~allowed)


def attached_field(rows: DataFrame, fields: DataFrame, on: str, field: str) -> DataFrame:
    """Rows with a boolean field of another table; a row without it is an error."""
    both = rows.drop(field).join(fields.select(on, field), on, "left")
    lost = F.raise_error(F.concat(F.lit(f"no {field} for "), F.col(on).cast("string"))).cast("boolean")
    return both.withColumn(field, F.coalesce(field, lost))


def in_order(scores: DataFrame, manifest: DataFrame, on: str, ordinal: str = "ordinal") -> DataFrame:
    """Scores with the place that their row has in a manifest; rows the manifest lacks are left out."""
    return scores.join(manifest.select(on, ordinal), on)
