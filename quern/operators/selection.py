"""Deterministic drawing: ranks, caps, quotas, balance, runs and budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import RANK_SEED, rank_key
from .running import numbered


def top_per_group(rows: DataFrame, groups: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; 0 keeps all. Spark prunes each task's groups to
    ``k`` rows before the shuffle."""
    if k <= 0:
        return rows
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def drawn_per_source(rows: DataFrame, k: int, source: str = "source", key: str = "track_id", seed: str = "42") -> DataFrame:
    return top_per_group(rows, [source], [rank_key(key, seed), F.col(key)], k)


def capped_sample(rows: DataFrame, limit: int, owner: str, track: str, cap: int = 2, seed: str = RANK_SEED) -> DataFrame:
    """Tracks in rank order, at most ``cap`` of an owner (case folded), ``limit`` in all;
    every row of a chosen track is kept."""
    tracks = rows.groupBy(track).agg(F.min(F.lower(owner)).alias("_owner"), F.count_distinct(F.lower(owner)).alias("_owners"))
    tracks = tracks.select(track, F.when(F.col("_owners") > 1, F.raise_error(F.concat(F.lit("conflicting owners: "), F.col(track).cast("string")))).otherwise(F.col("_owner")).alias("_owner"), rank_key(track, seed).alias("_rank"))
    capped = top_per_group(tracks, ["_owner"], [F.col("_rank")], cap)
    chosen = capped.orderBy("_rank").limit(limit).select(track)
    return rows.join(chosen, track, "left_semi")


def first_reason(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first rule that applies."""
    out = F.lit(otherwise)
    for name, test in reversed(rules):
        out = F.when(F.coalesce(test, F.lit(False)), name).otherwise(out)
    return out


def quota_selection(rows: DataFrame, rules: list[tuple[str, Column]], provider: str, owner: str, key: str, cap: int = 2, quota: int = 200, seed: str = RANK_SEED) -> DataFrame:
    """``reason`` for every candidate: a row rule, the owner's cap, the provider's quota, or
    ``selected``. Caps and quotas count selected rows only.

    Of an owner's candidates the first ``cap`` in rank order can be selected, and of those
    the first ``quota`` of a provider. A later candidate of an owner is over the cap if
    ``cap`` of the owner's were selected before it, and else over the quota.
    """
    judged = rows.withColumn("_rule", first_reason(rules, "")).withColumn("_rank", rank_key(key, seed))
    fit = F.col("_rule") == ""
    in_owner = F.row_number().over(Window.partitionBy(provider, owner, "_rule").orderBy("_rank", key))
    judged = judged.withColumn("_n", F.when(fit, in_owner))
    under = fit & (F.col("_n") <= cap)
    by_provider = Window.partitionBy(provider).orderBy("_rank", key).rowsBetween(Window.unboundedPreceding, 0)
    judged = judged.withColumn("_q", F.sum(under.cast("int")).over(by_provider))
    chosen = under & (F.col("_q") <= quota)
    judged = judged.withColumn("_chosen", F.coalesce(chosen, F.lit(False)))
    before = Window.partitionBy(provider, owner).orderBy("_rank", key).rowsBetween(Window.unboundedPreceding, -1)
    judged = judged.withColumn("_taken", F.coalesce(F.sum(F.col("_chosen").cast("int")).over(before), F.lit(0)))
    reason = F.when(~fit, F.col("_rule")).when(F.col("_chosen"), "selected").when(F.col("_taken") >= cap, "owner_cap").otherwise("provider_quota")
    return judged.withColumn("reason", reason).drop("_rule", "_rank", "_n", "_q", "_chosen", "_taken")


def balanced_rounds(rows: DataFrame, source: str, group: str, key: str, limit: int, seed: str = RANK_SEED, cell: str = "codec-cell:") -> DataFrame:
    """One row of each group, then sources in turn in the order of their own rank."""
    ranked = rows.withColumn("_rank", rank_key(key, seed))
    once = top_per_group(ranked, [group], [F.col("_rank"), F.col(key)], 1)
    turn = F.row_number().over(Window.partitionBy(source).orderBy("_rank", key))
    once = once.withColumn("_turn", turn).withColumn("_cell", rank_key(F.concat(F.lit(cell), F.col(source)), seed))
    return once.orderBy("_turn", "_cell").limit(limit).drop("_rank", "_turn", "_cell")


def preferred_take(rows: DataFrame, group: str, family: str, path: str, preferred: Column, cap: int, seed: str = RANK_SEED) -> DataFrame:
    """Up to ``cap`` rows of each group: preferred ones first, each kind by family rank, then path."""
    order = [F.when(F.coalesce(preferred, F.lit(False)), 0).otherwise(1), rank_key(family, seed), F.col(path)]
    return top_per_group(rows, [group], order, cap)


def extremes(rows: DataFrame, source: str, value: str, key: str, seed: str = RANK_SEED) -> DataFrame:
    """The first row of each source by rank, and the rows of least and largest value overall."""
    rank = rank_key(key, seed)
    first = top_per_group(rows, [source], [rank, F.col(key)], 1)
    ends = rows.agg(F.min_by(key, F.struct(F.col(value), rank)).alias("lo"), F.max_by(key, F.struct(F.col(value), rank)).alias("hi"))
    ends = ends.select(F.explode(F.array("lo", "hi")).alias(key)).distinct()
    return first.unionByName(rows.join(F.broadcast(ends), key, "left_semi")).dropDuplicates([key])


def _placed(rows: DataFrame, order: list[Column], groups: list[str] | None) -> DataFrame:
    """``_place`` of each row from 0: of its group, or of the whole table without ordering it in one task."""
    if groups:
        return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)) - 1)
    return numbered(rows, order, "_place")


def stride(rows: DataFrame, order: list[Column], step: int, groups: list[str] | None = None) -> DataFrame:
    """Every ``step``-th row in order, from the first, of each group."""
    return _placed(rows, order, groups).where(F.col("_place") % step == 0).drop("_place")


def share(rows: DataFrame, order: list[Column], parts: int, groups: list[str] | None = None) -> DataFrame:
    """``part``: rows dealt out in turn."""
    return _placed(rows, order, groups).withColumn("part", F.pmod("_place", F.lit(parts)).cast("int")).drop("_place")


def contiguity(records: DataFrame, shard: str, offset: str, size: str, block: int = 512) -> DataFrame:
    """Records of a shard that do not start where the one before ends (padded to blocks)."""
    by_shard = Window.partitionBy(shard).orderBy(offset)
    end = F.col(offset) + F.ceil(F.col(size) / block).cast("long") * block
    before = F.coalesce(F.lag(end).over(by_shard), F.lit(0).cast("long"))
    return records.withColumn("expected_offset", before).where(F.col(offset) != F.col("expected_offset"))


def runs(rows: DataFrame, groups: list[str], order: str, value: Column, threshold: float, least: int = 2, width: int = 5) -> DataFrame:
    """Spans of at least ``least`` neighbours whose value reaches the threshold, in units of ``width``."""
    w = Window.partitionBy(*groups).orderBy(order)
    hit = rows.select(*groups, F.col(order).alias("i"), (value >= threshold).alias("hit"))
    hit = hit.withColumn("_n", F.row_number().over(Window.partitionBy(*groups).orderBy("i")) - 1)
    edge = F.coalesce(F.col("hit") != F.lag("hit").over(Window.partitionBy(*groups).orderBy("i")), F.lit(True))
    hit = hit.withColumn("_run", F.sum(edge.cast("int")).over(Window.partitionBy(*groups).orderBy("i")))
    spans = hit.where("hit").groupBy(*groups, "_run").agg(F.min("_n").alias("first"), F.max("_n").alias("last"))
    spans = spans.where(F.col("last") - F.col("first") + 1 >= least)
    return spans.select(*groups, (F.col("first") * width).alias("start"), ((F.col("last") + 1) * width).alias("end"))


def budget_fill(rows: DataFrame, tiers: list[dict[str, int]], budget: int, group: str, family: str, path: str, size: str, seed: str = RANK_SEED) -> DataFrame:
    """Tiers in order; inside a tier groups take turns, each up to its cap, and an item that
    exceeds what is left is passed over while later ones may still fit.

    Ranking and caps are windows. The fill itself depends on every item before, so the
    capped candidates, whose number the caps bound, run through one ordered task.
    """
    cap, tier = F.lit(0), F.lit(None).cast("int")
    for i, t in reversed(list(enumerate(tiers))):
        for name, most in t.items():
            cap = F.when(F.col(group) == name, most).otherwise(cap)
            tier = F.when(F.col(group) == name, i).otherwise(tier)
    turn = F.row_number().over(Window.partitionBy(group).orderBy(rank_key(family, seed), path))
    dealt = rows.withColumn("_cap", cap).withColumn("_tier", tier).where("_tier is not null").withColumn("_turn", turn).where("_turn <= _cap")
    order = F.struct("_tier", "_turn", F.col(group).alias("g"))
    queue = dealt.select(F.col(path).alias("path"), F.col(size).cast("long").alias("size"), order.alias("o")).select("path", "size", "o._tier", "o._turn", "o.g")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = budget
        for pdf in batches:
            taken = []
            for p, n in zip(pdf["path"], pdf["size"]):
                if n <= left:
                    taken.append(p)
                    left -= n
            yield pd.DataFrame({"path": taken}, dtype=object)

    chosen = queue.repartition(1).sortWithinPartitions("_tier", "_turn", "g").select("path", "size").mapInPandas(fill, "path string")
    return rows.join(chosen.withColumnRenamed("path", path), path, "left_semi")


def preference_order(rows: DataFrame, groups: list[str], preferred: Column, *then: str) -> DataFrame:
    """``place`` of each row in its group: preferred rows first, then by the other columns."""
    order = Window.partitionBy(*groups).orderBy(F.when(preferred, 0).otherwise(1), *then)
    return rows.withColumn("place", F.row_number().over(order))


def lossless_eligible(partition: Column, codec: Column, legacy: str = "legacy") -> Column:
    """Rows of the legacy partition whose codec is linear PCM or FLAC."""
    return (partition == legacy) & (codec.startswith("pcm_") | (codec == "flac"))


def before_date(day: Column, cut: str) -> Column:
    """Whether a date text is before a cut; without a date it is."""
    return F.coalesce(day, F.lit("")) < cut


def hash_shuffled(rows: DataFrame, key: str, seed: str, groups: list[str] | None = None) -> DataFrame:
    """``place`` of each row of its group in an order that a seed draws."""
    order = Window.partitionBy(*(groups or [F.substring(rank_key(key, seed), 1, 3)])).orderBy(rank_key(key, seed))
    return rows.withColumn("place", F.row_number().over(order))
