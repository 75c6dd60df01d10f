"""Rank keys, short ids and digests as columns."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default seed of the ranking keys (fixed value).
RANK_SEED = "260905"


def _text(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("string")


def sha256_hex(x: Column | str) -> Column:
    return F.sha2(_text(x), 256)


def rank_key(key: Column | str, seed: str | int = RANK_SEED) -> Column:
    """Hex SHA-256 of ``seed:key``: the order in which items are drawn."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), _text(key)), 256)


def binary_rank_key(key: Column | str, seed: str | int = RANK_SEED) -> Column:
    """``rank_key`` for names that need not be UTF-8: hashes the bytes."""
    raw = F.col(key) if isinstance(key, str) else key
    return F.sha2(F.concat(F.lit(f"{seed}:").cast("binary"), raw.cast("binary")), 256)


def split_rank(source: Column | str, lineage: Column | str, salt: str) -> Column:
    """Digest that decides an item's split: salt, source and lineage."""
    return F.sha2(F.concat_ws(":", F.lit(salt), _text(source), _text(lineage)), 256)


def short_id(x: Column | str, prefix: str, digits: int, algorithm: str = "sha256") -> Column:
    """``prefix`` and the first hex digits of a digest."""
    digest = F.sha1(_text(x)) if algorithm == "sha1" else F.sha2(_text(x), 256)
    return F.concat(F.lit(prefix), F.substring(digest, 1, digits))


def record_seed(x: Column | str) -> Column:
    """The first eight hex digits of the SHA-256 as a number: a record's random seed."""
    return F.conv(F.substring(sha256_hex(x), 1, 8), 16, 10).cast("long")


def unit_hash(x: Column | str, seed: str | int = RANK_SEED) -> Column:
    """A number in [0, 1) from the first eight hex digits of the rank key."""
    return F.conv(F.substring(rank_key(x, seed), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def joined_digest(values: Column, separator: str = "\n", ending: str = "") -> Column:
    """Aggregate: SHA-256 of a group's values, sorted and joined; ``ending`` follows each."""
    ordered = F.array_sort(F.collect_list(values.cast("string")))
    if ending:
        return F.sha2(F.concat(F.array_join(ordered, ending), F.when(F.size(ordered) > 0, F.lit(ending)).otherwise("")), 256)
    return F.sha2(F.array_join(ordered, separator), 256)


def ordered_digest(order: Column, value: Column, separator: str = "\n") -> Column:
    """Aggregate: SHA-256 of a group's values joined in the order of ``order``."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.cast("string").alias("v"))))
    return F.sha2(F.array_join(F.transform(pairs, lambda p: p["v"]), separator), 256)


def set_digest(value: Column) -> Column:
    """Aggregate: an order-free digest of a whole table's values, for tables whose values
    do not fit one row: the sum and the count of 64-bit hashes."""
    return F.concat_ws(":", F.sum(F.xxhash64(value).cast("decimal(38,0)")).cast("string"), F.count(value).cast("string"))


def record_digest(*values: Column | str) -> Column:
    """SHA-256 of a row's values as texts, tab-joined; null is empty."""
    return F.sha2(F.concat_ws("\t", *[F.coalesce(_text(v), F.lit("")) for v in values]), 256)


def row_sum(*values: Column | str) -> Column:
    """Aggregate: an order-free digest of rows, the sum of the first 12 hex digits of their digests
    modulo 2**64, as a signed number: from some 65,000 rows on the sum itself may need more bits."""
    whole = F.sum(F.conv(F.substring(record_digest(*values), 1, 12), 16, 10).cast("decimal(15,0)")) % F.lit(Decimal(1 << 64))
    high = whole >= F.lit(Decimal(1 << 63))
    return F.when(high, whole - F.lit(Decimal(1 << 64))).otherwise(whole).cast("long")
