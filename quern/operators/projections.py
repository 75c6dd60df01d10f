"""Published forms of rows: ids, nested fields, outcomes, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import sha256_hex, short_id, split_rank


def prefix_case(x: Column, table: dict[str, str], missing: str | None = None) -> Column:
    """The value of the first prefix that ``x`` starts with; without one an error, or ``missing``."""
    out = F.lit(missing) if missing is not None else F.raise_error(F.concat(F.lit("no group for "), F.coalesce(x, F.lit("null"))))
    for prefix, value in reversed(list(table.items())):
        out = F.when(x.startswith(prefix), value).otherwise(out)
    return out


def public_rows(rows: DataFrame, salt: str, retrieval: dict[str, tuple[str, str]], digest: str = "audio_sha256", lineage: str = "lineage_id") -> DataFrame:
    """Public form: hashed ids, split rank and how to retrieve the item by its source."""
    source = F.col("source")
    mode, upstream = F.lit("digest_match"), F.lit("unknown")
    for prefix, (m, u) in reversed(list(retrieval.items())):
        mode, upstream = F.when(source.startswith(prefix), m).otherwise(mode), F.when(source.startswith(prefix), u).otherwise(upstream)
    basis = F.coalesce(F.col(lineage).cast("string"), F.col(digest))
    return rows.select(
        F.concat(F.lit("ab2-"), F.substring(F.col(digest), 1, 20)).alias("public_id"), "label", "source", short_id(basis, "ab2l-", 20).alias("public_lineage"),
        split_rank("source", basis, salt).alias("split_rank"), sha256_hex("track_id").alias("legacy_id_sha256"), F.struct(mode.alias("mode"), upstream.alias("upstream")).alias("retrieval"),
    )


def prediction_rows(rows: DataFrame) -> DataFrame:
    """Published predictions: the probability only of scored rows, the error only of others."""
    scored = F.col("outcome") == "scored"
    return rows.select("id", "outcome", F.when(scored, F.col("prob")).alias("prob"), F.when(~scored, F.col("error")).alias("error"))


def unnested_variants(rows: DataFrame, variants: str, keep: list[str]) -> DataFrame:
    return rows.select(*keep, F.posexplode(variants).alias("at", "variant"))


def wide(rows: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """Matrix of one value by two keys, null where a pair is missing."""
    return rows.groupBy(row).pivot(column, columns).agg(F.first(value))


def creator_alias(provider: Column, handle: Column, artist: Column) -> Column:
    """``suno:@handle`` or ``udio:artist:name``, in lower case; null without a name."""
    at = F.regexp_replace(F.lower(handle), "^@+", "")
    name = F.trim(F.regexp_replace(F.lower(artist), r"\s+", " "))
    return F.when(provider == "suno", F.when(handle != "", F.concat(F.lit("suno:@"), at))).otherwise(F.when(name != "", F.concat(F.lit("udio:artist:"), name)))


def remapped(rows: DataFrame, ids: DataFrame, key: str = "track_id") -> DataFrame:
    """Rows under their public ids; rows without one are left out, paths are dropped."""
    named = rows.join(ids.select(F.col(key), F.col("public_id")), key).drop(key, "path", "runtime_path")
    return named.withColumnRenamed("public_id", key)


def keyed(rows: DataFrame, fields: list[str], model: str) -> DataFrame:
    """Copies of the fields under a model's name; older copies are replaced."""
    return rows.drop(*[f"{f}_{model}" for f in fields]).withColumns({f"{f}_{model}": F.col(f) for f in fields})


def evidence(*choices: tuple[Column, Column], missing: str) -> Column:
    """The value of the first choice ``(condition, value)`` that holds and is not null."""
    return F.coalesce(*[F.when(c, v) for c, v in choices], F.lit(missing))


def transport_cases(rows: DataFrame, key: str, views: list[str]) -> DataFrame:
    """``id`` of every view of every row, ``key--view``; a repeated key is an error."""
    once = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    name = F.when(F.col("_n") == 1, F.col(key).cast("string")).otherwise(F.raise_error(F.concat(F.lit("repeated key: "), F.col(key).cast("string"))).cast("string"))
    view = F.explode(F.array(*[F.lit(v) for v in views])).alias("view")
    return once.select(key, name.alias("_name"), view).select(key, "view", F.concat_ws("--", "_name", "view").alias("id"))


def part_label(seen: Column) -> Column:
    return F.when(seen, "seen").otherwise("unseen")


def source_name(group: Column, prefix: str = "set_") -> Column:
    return F.concat(F.lit(prefix), group)
