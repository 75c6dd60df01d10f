"""Constraints as tables of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
LOCAL_PATH = r"(^|[\s\"'])(/Users/|/home/|/mnt/|file://)"
URL = r"https?://\S+"


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """``(key, rule)`` for each rule that a row breaks; a rule that is null is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(F.col(key).cast("string").alias("key"), F.explode(broken).alias("rule"))


def required(*fields: str) -> dict[str, Column]:
    return {f"{f} is required": F.col(f).isNotNull() & (F.col(f).cast("string") != "") for f in fields}


def closed_schema(df: DataFrame, allowed: set[str]) -> list[str]:
    """Columns that the table must not have, and that it lacks."""
    have = set(df.columns)
    return sorted(f"unexpected: {c}" for c in have - allowed) + sorted(f"absent: {c}" for c in allowed - have)


def private_text(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """E-mail addresses and local paths in string columns, URLs taken out first."""
    def clean(c: str) -> Column:
        return F.regexp_replace(F.coalesce(F.col(c), F.lit("")), URL, "")

    rules = {f"{c}: e-mail address": ~clean(c).rlike(EMAIL) for c in columns} | {f"{c}: local path": ~clean(c).rlike(LOCAL_PATH) for c in columns}
    return violations(rows, key, rules)


def unequal_digests(expected: DataFrame, actual: DataFrame, key: str, digest: str) -> DataFrame:
    """``(key, rule)``: missing, unlisted or changed files."""
    a, b = expected.select(F.col(key).alias("k"), F.col(digest).alias("want")), actual.select(F.col(key).alias("k2"), F.col(digest).alias("got"))
    both = a.join(b, F.col("k") == F.col("k2"), "full_outer")
    rule = F.when(F.col("k2").isNull(), "missing").when(F.col("k").isNull(), "unlisted").when(~F.col("want").eqNullSafe(F.col("got")), "changed")
    return both.select(F.coalesce("k", "k2").alias("key"), rule.alias("rule")).where("rule is not null")


def binding_outcome(given: Column, valid: Column, found: Column, size_ok: Column, digest_ok: Column) -> Column:
    """Outcome of binding a local file to a row."""
    return (
        F.when(~given, "not_provided").when(~valid, "invalid_local_path").when(~found, "not_a_file").when(~size_ok, "size_mismatch")
        .when(~digest_ok, "hash_mismatch").otherwise("bound")
    )


def conflicting(rows: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """``(group, field, n)`` of fields with more than one value in a group."""
    counts = rows.groupBy(F.col(group).cast("string").alias("group")).agg(*[F.count_distinct(f).alias(f) for f in fields])
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n")) for f in fields]))
    return counts.select("group", cells.alias("c")).select("group", "c.*").where("n > 1")


def all_pass(*checks: DataFrame) -> DataFrame:
    """One row: the number of violations and whether there are none."""
    rows = reduce(DataFrame.unionByName, checks)
    return rows.agg(F.count(F.lit(1)).alias("violations")).withColumn("ready", F.col("violations") == 0)
