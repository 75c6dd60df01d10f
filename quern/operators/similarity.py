"""Exact and near copies of fingerprint sequences."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stage


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def exact_copies(rows: DataFrame, key: str, digests: list[str]) -> DataFrame:
    """``(kind, digest, n, first)`` of digests that more than one key has."""
    kinds = F.explode(F.array(*[F.struct(F.lit(d).alias("kind"), F.col(d).alias("digest")) for d in digests]))
    flat = rows.select(F.col(key).alias("k"), kinds.alias("x")).select("k", "x.*").where("digest is not null")
    return flat.groupBy("kind", "digest").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first")).where("n > 1")


def sign_bits(vector: Column) -> Column:
    """A 64-bit number from the signs of a vector's first 64 elements."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.get(vector, i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def sequence_tokens(rows: DataFrame, key: str, sequence: str) -> DataFrame:
    """``(key, token, at)``: for each half of 32-bit frames, that of a frame with that of the
    frame three on."""
    def half(i: Column, shift: int) -> Column:
        return F.shiftright(F.get(F.col(sequence), i), shift).bitwiseAND(65535)

    def tokens(shift: int) -> Column:
        at = F.sequence(F.lit(0), F.size(sequence) - 4)
        return F.transform(at, lambda i: F.struct((F.lit(1 if shift else 0) * (1 << 32) + half(i, shift) * 65536 + half(i + 3, shift)).cast("long").alias("token"), i.alias("at")))

    long_enough = rows.where(F.size(sequence) >= 4)
    return long_enough.select(F.col(key).alias("key"), F.explode(F.concat(tokens(0), tokens(16))).alias("t")).select("key", "t.token", "t.at")


def copy_candidates(rows: DataFrame, key: str, sequence: str, max_postings: int = 200, max_keys: int = 20, votes: int = 8, least_frames: int = 80, max_error: float = 0.20) -> DataFrame:
    """``(a, b, bit_error, frames, offset)`` of pairs whose sequences match at an offset.

    Tokens with many postings tell nothing and are left out: that is the operator's rule, with
    ``max_postings`` and ``max_keys`` as its parameters, and its results are defined by it (all
    equal sequences are found by ``exact_copies``). What remains is joined to itself, so a token
    gives at most ``max_postings`` squared rows. Pairs vote for offsets, and only voted offsets are verified frame by frame.
    """
    tokens = sequence_tokens(rows, key, sequence)
    rare = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("k")).where((F.col("n") <= max_postings) & (F.col("k") <= max_keys)).select("token")
    kept = tokens.join(rare, "token")
    a, b = kept.select("token", F.col("key").alias("a"), F.col("at").alias("at_a")), kept.select("token", F.col("key").alias("b"), F.col("at").alias("at_b"))
    met = a.join(b, "token").where("a < b").withColumn("bin", F.floor((F.col("at_a") - F.col("at_b")) / 2))
    voted = met.groupBy("a", "b", "bin").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= votes)
    offsets = voted.select("a", "b", F.explode(F.sequence(F.col("bin") * 2 - 2, F.col("bin") * 2 + 3)).alias("offset")).distinct()
    left, right = (rows.select(F.col(key).alias(k), F.col(sequence).alias(f"s{k}")) for k in ("a", "b"))
    both = offsets.join(left, "a").join(right, "b")
    ia, ib = F.greatest("offset", F.lit(0)), F.greatest(-F.col("offset"), F.lit(0))
    frames = F.least(F.size("sa") - ia, F.size("sb") - ib).cast("int")
    both = both.withColumn("frames", frames).where(F.col("frames") >= F.greatest(F.lit(float(least_frames)), 0.5 * F.least(F.size("sa"), F.size("sb"))))
    differ = F.zip_with(F.slice("sa", (ia + 1).cast("int"), F.col("frames")), F.slice("sb", (ib + 1).cast("int"), F.col("frames")), lambda x, y: F.bit_count(x.bitwiseXOR(y).bitwiseAND(0xFFFFFFFF)))
    error = F.aggregate(differ, F.lit(0), lambda s, x: s + x) / (32.0 * F.col("frames"))
    best = F.min(F.struct(error.alias("bit_error"), (-F.col("frames")).alias("f"), F.col("offset").alias("offset")))
    out = both.groupBy("a", "b").agg(best.alias("m")).select("a", "b", "m.bit_error", (-F.col("m.f")).alias("frames"), "m.offset")
    return out.where(F.col("bit_error") <= max_error)


def block_links(rows: DataFrame, key: str, bits: str, radius: int = 3, bucket_values: int = 4096) -> DataFrame:
    """``(a, b, distance)`` of 64-bit values within ``radius``.

    Every value stands for the keys that have it through the smallest of them: pairs are
    between these, each once, and the other keys of a value are linked to theirs at distance
    0, so equal values never make all their pairs. Two values within the radius agree on all
    bits of some choice of blocks, on which the values are joined to themselves; with more
    values more blocks are cut and longer choices taken, so that a bucket of unlike values
    stays at about ``bucket_values``.
    """
    named = rows.select(F.col(key).alias("k"), F.col(bits).alias("x"))
    values = stage(named.groupBy("x").agg(F.min("k").alias("k")), "distinct-values")
    n = values.count()
    blocks = next((c for c in range(radius + 1, radius + 4) if n >> (64 * (c - radius) // c) <= bucket_values), radius + 3)
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:])]
    masks = [sum(c) for c in combinations(parts, blocks - radius)]
    kept = F.array(*[F.struct(F.lit(i).alias("i"), F.col("x").bitwiseAND(m - (1 << 64) if m >> 63 else m).alias("v")) for i, m in enumerate(masks)])
    flat = values.select("k", "x", F.explode(kept).alias("p")).select("k", "x", "p.i", "p.v")
    a, b = (flat.select("i", "v", F.col("k").alias(n), F.col("x").alias(f"x{n}")) for n in ("a", "b"))
    met = a.join(b, ["i", "v"]).where("a < b").withColumn("distance", hamming(F.col("xa"), F.col("xb"))).where(F.col("distance") <= radius)
    copies = named.join(values.withColumnRenamed("k", "a"), "x").where("a <> k").select("a", F.col("k").alias("b"), F.lit(0).alias("distance"))
    return met.select("a", "b", "distance").distinct().unionByName(copies)


def normalized_correlation(a: Column, b: Column) -> Column:
    """Correlation of two equally long arrays; 0 if either is constant."""
    def mean(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)

    def centred(x: Column) -> Column:
        return F.element_at(F.transform(F.array(mean(x)), lambda m: F.transform(x, lambda v: v - m)), 1)

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    ca, cb = centred(a), centred(b)
    norm = F.sqrt(dot(ca, ca) * dot(cb, cb))
    return F.when(norm > 1e-12, dot(ca, cb) / norm).otherwise(0.0)
