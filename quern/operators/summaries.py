"""Grouped summaries, gates and audits of manifests and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import percentile, ratio, upper_median, wilson
from .running import from_the_top

#: Gates of the source summary (fixed values).
REAL_FPR_MAX = 0.05
POSITIVE_TPR_MIN = 0.90
SOFT_TPR_MIN = {"aime_stable_audio_v1": 0.60, "aime_stable_audio_v2": 0.60}
PAIR_MEAN_MAX = 0.15
PAIR_MAX_MAX = 0.35
REGRESSION_FPR = 0.03
REGRESSION_TPR = 0.05


def source_summary(rows: DataFrame, threshold: float, source: str = "source", prob: str = "prob", label: str = "label", order: str | None = None) -> DataFrame:
    """``n, attempted, failures``, moments and the rate of the source's own class.

    Rows without a probability are failures: they count as attempted and nowhere else. A
    source takes the label of its first scored row by ``order``; a source without scores
    has null statistics.
    """
    scored = F.col(prob).isNotNull()
    first = F.min_by(F.when(scored, F.col(label)), F.when(scored, F.col(order))) if order else F.min(F.when(scored, F.col(label)))
    called = F.avg(F.when(scored, (F.col(prob) >= threshold).cast("double")))
    out = rows.groupBy(source).agg(
        F.count_if(scored).alias("n"), F.count(F.lit(1)).alias("attempted"), F.count_if(~scored).alias("failures"), first.alias("label"),
        F.avg(prob).alias("prob_mean"), percentile(F.col(prob), 0.5).alias("prob_median"), percentile(F.col(prob), 0.1).alias("prob_p10"),
        percentile(F.col(prob), 0.9).alias("prob_p90"), called.alias("called"),
    )
    return out.select("*", F.when(F.col("label") == 1, F.col("called")).alias("tpr"), F.when(F.col("label") == 0, F.col("called")).alias("fpr")).drop("called")


def value_counts(rows: DataFrame, field: str, missing: str = "<missing>") -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(field).cast("string"), F.lit(missing)).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def duplicates(rows: DataFrame, field: str, ordinal: str) -> DataFrame:
    """Values that occur more than once, with their row numbers; null and empty are ignored."""
    found = rows.where(F.col(field).isNotNull() & (F.col(field).cast("string") != ""))
    out = found.groupBy(F.col(field).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(ordinal)), ",").alias("rows"))
    return out.where("n > 1")


def manifest_audit(rows: DataFrame, declared: dict[str, int], required: list[str], key: str) -> DataFrame:
    """``(check, expected, actual, status)`` of declared counts, required fields and keys."""
    n = F.count(F.lit(1))
    missing = [F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(f"missing:{c}") for c in required]
    counted = rows.agg(n.alias("rows"), F.count_distinct(key).alias("distinct"), *missing)
    want = {"rows": declared.get("rows"), "distinct": declared.get("distinct")} | {f"missing:{c}": 0 for c in required}
    checks = F.array(*[F.struct(F.lit(k).alias("check"), F.lit(v).cast("long").alias("expected"), F.col(k).alias("actual")) for k, v in want.items()])
    out = counted.select(F.explode(checks).alias("c")).select("c.*")
    status = F.when(F.col("expected").isNull(), "missing_metadata").when(F.col("expected") == F.col("actual"), "match").otherwise("mismatch")
    return out.withColumn("status", status)


def folder_rollup(files: DataFrame, folder: Column, size: str, extension: Column, shard: str) -> DataFrame:
    """Files, bytes, distinct shards and the extension histogram of each folder."""
    named = files.select(folder.alias("folder"), F.col(size).alias("size"), extension.alias("ext"), F.col(shard).alias("shard"))
    exts = named.groupBy("folder", "ext").agg(F.count(F.lit(1)).alias("n"))
    exts = exts.groupBy("folder").agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%s=%d", "ext", "n"))), ",").alias("extensions"))
    sums = named.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.count_distinct("shard").alias("shards"))
    return sums.join(exts, "folder")


def with_total(summary: DataFrame, key: str, sums: list[str], total: str = "total") -> DataFrame:
    """A grouped table with a total row, by ROLLUP."""
    out = summary.rollup(key).agg(*[F.sum(s).alias(s) for s in sums], F.grouping(key).alias("_g"))
    return out.withColumn(key, F.when(F.col("_g") == 1, total).otherwise(F.col(key))).drop("_g")


def seen_counts(rows: DataFrame, source: str, seen: str, role: str, roles: tuple[str, str] = ("eval", "train_pool")) -> DataFrame:
    yes = F.col(seen)
    cells = [F.count_if((F.col(role) == r) & (yes if s == "seen" else ~yes)).alias(f"{r}_{s}") for r in roles for s in ("seen", "unseen")]
    return rows.groupBy(source).agg(F.count(F.lit(1)).alias("total"), F.count_if(yes).alias("seen"), F.count_if(~yes).alias("unseen"), *cells)


def split_report(rows: DataFrame, seen: str, dims: tuple[str, str], called: Column, positive: Column, prob: str = "prob", label: str = "label") -> DataFrame:
    """Rate blocks for all, seen and unseen rows over every grouping of two dimensions.

    One pass: each row is exploded to its two splits and GROUPING SETS does the rest.
    ``k`` counts wrong calls: false negatives of positives, false positives of others.
    """
    a, b = dims
    split = F.explode(F.array(F.lit("all"), F.when(F.col(seen), "seen").otherwise("unseen")))
    wrong = F.when(positive, ~called).otherwise(called)
    flat = rows.select(split.alias("split"), F.col(a).alias("dim_a"), F.col(b).alias("dim_b"), F.col(label).alias("label"), F.col(prob).alias("prob"), wrong.alias("wrong"))
    sets = [["split", "label"], ["split", "label", "dim_a"], ["split", "label", "dim_b"], ["split", "label", "dim_a", "dim_b"]]
    grouped = flat.groupingSets([[F.col(c) for c in s] for s in sets], F.col("split"), F.col("label"), F.col("dim_a"), F.col("dim_b"))
    out = grouped.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("wrong").alias("k"), upper_median("prob").alias("prob_median"), F.grouping("dim_a").alias("ga"), F.grouping("dim_b").alias("gb"),
    )
    low, high = wilson(F.col("k"), F.col("n"))
    return out.select(
        "split", "label", F.when(F.col("ga") == 1, "*").otherwise(F.col("dim_a")).alias("dim_a"), F.when(F.col("gb") == 1, "*").otherwise(F.col("dim_b")).alias("dim_b"),
        "n", "k", ratio(F.col("k"), F.col("n")).alias("rate"), low.alias("lower"), high.alias("upper"), "prob_median",
    )


def complete_groups(report: DataFrame, keys: DataFrame, on: list[str], counts: list[str]) -> DataFrame:
    """The report on a full list of keys: a group without rows has counts of 0, rates null."""
    return keys.join(report, on, "left").fillna(0, counts)


def versus_negatives(rows: DataFrame, group: str, positive: Column, negative: Column, prob: str = "prob") -> DataFrame:
    """AUROC of each group's positives against one fixed set of negatives.

    The negatives' running totals are worked out once, over all distinct scores; every
    group's score counts look theirs up by score.
    """
    neg = rows.where(negative).groupBy(F.col(prob).alias("prob")).agg(F.count(F.lit(1)).alias("neg"))
    pos = rows.where(positive).groupBy(F.col(group).alias("group"), F.col(prob).alias("prob")).agg(F.count(F.lit(1)).alias("pos"))
    scores = neg.unionByName(pos.select("prob", F.lit(0).cast("long").alias("neg"))).groupBy("prob").agg(F.sum("neg").alias("neg"))
    below = from_the_top(scores, [], "prob", ["neg"])
    total = neg.agg(F.sum("neg").alias("N"))
    won = pos.join(below, "prob").join(F.broadcast(total))  # one row
    beaten = F.col("pos") * (F.col("N") - F.col("cum_neg") + F.col("neg") / 2.0)
    return won.groupBy("group").agg(F.try_divide(F.sum(beaten), F.sum("pos") * F.max("N").cast("double")).alias("auroc"))


def coverage(rows: DataFrame, groups: list[str], scored: Column, failed: Column) -> DataFrame:
    """Attempted, scored, failed and missing rows; a row is missing if neither scored nor failed."""
    out = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("attempted"), F.count_if(scored).alias("scored"), F.count_if(failed & ~scored).alias("failed"), F.count_if(~scored & ~failed).alias("missing"))
    return out.withColumn("failure_rate", ratio(F.col("failed"), F.col("attempted")))


def source_gates(summary: DataFrame, source: str = "source", soft: dict[str, float] | None = None) -> DataFrame:
    """Messages of sources beyond their gate: FPR of negatives, TPR of positives."""
    least = F.lit(POSITIVE_TPR_MIN)
    for name, value in (SOFT_TPR_MIN if soft is None else soft).items():
        least = F.when(F.col(source) == name, value).otherwise(least)
    judged = summary.withColumn("limit", F.when(F.col("label") == 0, REAL_FPR_MAX).otherwise(least)).withColumn("value", F.coalesce("fpr", "tpr"))
    bad = judged.where(((F.col("label") == 0) & (F.col("value") > F.col("limit"))) | ((F.col("label") == 1) & (F.col("value") < F.col("limit"))))
    kind = F.when(F.col("label") == 0, "real FPR").otherwise("AI TPR")
    sign = F.when(F.col("label") == 0, ">").otherwise("<")
    return bad.select(F.col(source).alias("source"), "value", "limit", F.format_string("%s: %s %.3f %s %.2f", F.col(source), kind, "value", sign, "limit").alias("message"))


def regressions(current: DataFrame, baseline: DataFrame, source: str = "source") -> DataFrame:
    """Sources whose FPR rose or TPR fell by more than allowed since the baseline."""
    b = baseline.select(F.col(source).alias("b_source"), F.col("fpr").alias("b_fpr"), F.col("tpr").alias("b_tpr"))
    both = current.join(b, F.col(source) == F.col("b_source"))
    delta = F.when(F.col("label") == 0, F.col("fpr") - F.col("b_fpr")).otherwise(F.col("b_tpr") - F.col("tpr"))
    allowed = F.when(F.col("label") == 0, REGRESSION_FPR).otherwise(REGRESSION_TPR)
    return both.select(F.col(source).alias("source"), "label", delta.alias("delta"), allowed.alias("allowed")).where("delta > allowed")


def worst_sources(summary: DataFrame, source: str = "source") -> DataFrame:
    """The lowest TPR and the highest FPR with their sources; of equals the first by name."""
    return summary.agg(
        F.min("tpr").alias("min_tpr"), F.min(F.when(F.col("tpr").isNotNull(), F.struct("tpr", source)))[source].alias("min_tpr_source"),
        F.max("fpr").alias("max_fpr"), F.min(F.when(F.col("fpr").isNotNull(), F.struct((-F.col("fpr")).alias("f"), F.col(source).alias("s"))))["s"].alias("max_fpr_source"),
    )


def group_sizes(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def release_counters(rows: DataFrame, by: list[str], groups: list[str]) -> DataFrame:
    """Rows and distinct groups of each cell of a release."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(g).alias(f"{g}s") for g in groups])


def index_totals(members: DataFrame, shard: str, path: str, size: str) -> DataFrame:
    """Members, distinct paths and bytes of each shard of an index."""
    return members.groupBy(F.col(shard).alias("shard")).agg(F.count(F.lit(1)).alias("files"), F.count_distinct(path).alias("paths"), F.sum(size).cast("long").alias("bytes"))


def ranking(rows: DataFrame, value: str, tie: str) -> DataFrame:
    """``place`` of each row by a value, descending, ties in the order of ``tie``. Places come from
    running counts of the distinct values, so no task orders the whole table."""
    counts = rows.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    above = from_the_top(counts, [], value, ["n"]).select(F.col(value).alias("_v"), (F.col("cum_n") - F.col("n")).alias("_above"))
    inside = F.row_number().over(Window.partitionBy(value).orderBy(tie))
    placed = rows.withColumn("_at", inside).join(above, F.col(value) == F.col("_v"))
    return placed.withColumn("place", (F.col("_above") + F.col("_at")).cast("int")).drop("_at", "_v", "_above")


def distinct_total(rows: DataFrame, by: list[str], identity: str, size: str) -> DataFrame:
    """Total size of each group, every identity counted once however often it occurs."""
    once = rows.groupBy(*by, identity).agg(F.max(size).alias("_s"))
    return once.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("_s").cast("long").alias("total"))


def broken_links(pages: DataFrame, key: str, html: str, known: DataFrame) -> DataFrame:
    """``(key, link)`` of distinct relative links in a page that are not in ``known(link)``."""
    found = F.array_distinct(F.regexp_extract_all(html, F.lit(r'href="(/[^"#?]*)'), 1))
    return pages.select(key, F.explode(found).alias("link")).join(known.select("link").distinct(), "link", "left_anti").select(key, "link")
