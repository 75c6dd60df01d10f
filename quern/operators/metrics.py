"""Classification metrics over ``(label 0/1, prob)`` rows, for any grouping.

Undefined values are null. Scores are first reduced to counts for each distinct score, a
partial aggregation; rank statistics then come from running totals over those counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import f1_clamped, f1_zero, ratio, wilson
from .running import from_the_top

THRESHOLDS = 201


def valid_probability(prob: Column) -> Column:
    """Finite and within [0, 1]; a null is not valid. NaN compares as largest in Spark, so
    it is asked for by name."""
    return F.coalesce(~F.isnan(prob) & prob.between(0.0, 1.0), F.lit(False))


def split_failures(rows: DataFrame, prob: str = "prob") -> tuple[DataFrame, DataFrame]:
    """Rows with a valid probability, and all others as failures of the inference stage."""
    ok = valid_probability(F.col(prob))
    failed = rows.where(~ok).withColumn("stage", F.lit("inference")).withColumn("error", F.lit("probability is not a finite number in [0, 1]"))
    return rows.where(ok), failed.drop(prob)


def confusion(called: Column, label: Column, weight: Column | None = None) -> list[Column]:
    """Aggregates ``tp, tn, fp, fn``."""
    w = F.lit(1).cast("long") if weight is None else weight

    def total(test: Column) -> Column:
        return F.sum(F.when(test, w).otherwise(F.lit(0)))

    one = label == 1
    return [total(one & called).alias("tp"), total(~one & ~called).alias("tn"), total(~one & called).alias("fp"), total(one & ~called).alias("fn")]


def rates() -> list[Column]:
    """From ``tp, tn, fp, fn``: rates that are null where a class is absent; F1 is 0 then."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    tpr, fpr = ratio(tp, tp + fn), ratio(fp, fp + tn)
    return [tpr.alias("tpr"), fpr.alias("fpr"), f1_zero(tp, fp, fn).alias("f1"), ((tpr + ratio(tn, tn + fp)) / 2).alias("balanced_accuracy")]


def score_counts(rows: DataFrame, groups: list[str], prob: str = "prob", label: str = "label", weight: str | None = None) -> DataFrame:
    """``(groups, prob, pos, neg)`` for each distinct score."""
    w = F.lit(1).cast("long") if weight is None else F.col(weight)
    one = F.col(label) == 1
    return rows.groupBy(*groups, prob).agg(F.sum(F.when(one, w).otherwise(0)).alias("pos"), F.sum(F.when(one, F.lit(0)).otherwise(w)).alias("neg"))


def rank_metrics(rows: DataFrame, groups: list[str], prob: str = "prob", label: str = "label", weight: str | None = None) -> DataFrame:
    """``(groups, auroc, auprc)``: exact, ties count one half; AUPRC is the step sum of
    average precision. Null where a class (for AUPRC, the positive one) is absent."""
    counts = score_counts(rows, groups, prob, label, weight)
    cum = from_the_top(counts, groups, prob, ["pos", "neg"])
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    above = F.col("cum_pos") - F.col("pos")  # positives that stand above this score
    parts = cum.groupBy(*groups).agg(
        F.sum(pos).alias("p"), F.sum(neg).alias("n"),
        F.sum(neg * (above + pos / 2)).alias("won"),
        F.sum(pos * F.try_divide(F.col("cum_pos").cast("double"), (F.col("cum_pos") + F.col("cum_neg")).cast("double"))).alias("area"),
    )
    return parts.select(*groups, F.try_divide("won", F.col("p") * F.col("n")).alias("auroc"), F.try_divide("area", "p").alias("auprc"))


def point_metrics(rows: DataFrame, threshold: float | str, groups: list[str] | None = None, prob: str = "prob", label: str = "label") -> DataFrame:
    """Counts, rates and rank metrics of each group at a threshold (a number or a column)."""
    groups = groups or []
    t = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    base = rows.withColumn("_all", F.lit(0))
    keys = groups or ["_all"]
    one = F.col(label) == 1
    table = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(one).alias("n_pos"), F.count_if(~one).alias("n_neg"), *confusion(F.col(prob) >= t, F.col(label)))
    table = table.select("*", *rates())
    ranks = rank_metrics(base, keys, prob, label)
    same = [table[k].eqNullSafe(ranks[k]) for k in keys]
    joined = table.join(ranks, same, "left").select(*[table[k] for k in keys], *[c for c in table.columns if c not in keys], "auroc", "auprc")
    return joined if groups else joined.drop("_all")


def failure_as_error(rows: DataFrame, threshold: float, prob: str = "prob", label: str = "label", groups: list[str] | None = None) -> DataFrame:
    """Lower bound in which a row without a score counts as an error of its class; no rank
    metric is given, since none was scored."""
    groups = groups or []
    scored, one = F.col(prob).isNotNull(), F.col(label) == 1
    called = F.when(scored, F.col(prob) >= threshold).otherwise(~one)
    out = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_attempted"), F.count_if(scored).alias("n_scored"), F.count_if(~scored).alias("n_failed"), *confusion(called, F.col(label)))
    return out.select("*", *rates())


def threshold_grid(steps: int = THRESHOLDS) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: i * F.lit(1.0 / (steps - 1)))


def threshold_sweep(rows: DataFrame, groups: list[str] | None = None, prob: str = "prob", label: str = "label", steps: int = THRESHOLDS) -> DataFrame:
    """Counts and clamped rates at ``steps`` even thresholds from 0 to 1.

    A score falls in the band of the thresholds it reaches, so rows are counted once and
    the grid is summed up over bands; nothing is crossed with the rows.
    """
    groups = groups or []
    step = 1.0 / (steps - 1)
    near = F.greatest(F.least(F.floor(F.col(prob) / step), F.lit(steps - 1)), F.lit(0)).cast("int")
    # The quotient may be one off its threshold in floating point: compare with the grid itself.
    band = F.when(F.col(prob) < near * F.lit(step), near - 1).when((near < steps - 1) & (F.col(prob) >= (near + 1) * F.lit(step)), near + 1).otherwise(near)
    counts = rows.withColumn("band", band).groupBy(*groups, "band").agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    packed = counts.groupBy(*groups).agg(F.collect_list(F.struct("band", "p", "n")).alias("b"), F.sum("p").alias("P"), F.sum("n").alias("N"))

    def at_least(field: str):
        def total(i: Column) -> Column:
            return F.aggregate(F.filter("b", lambda x: x["band"] >= i), F.lit(0).cast("long"), lambda a, x: a + x[field])

        return total

    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.struct(i.alias("i"), at_least("p")(i).alias("tp"), at_least("n")(i).alias("fp"))))
    out = packed.select(*groups, "P", "N", grid.alias("g")).select(*groups, "P", "N", "g.*")
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("P") - tp, F.col("N") - fp
    return out.select(
        *groups, (F.col("i") * F.lit(step)).alias("threshold"), tp, fp, fn.alias("fn"), tn.alias("tn"),
        (tp / F.greatest("P", F.lit(1))).alias("tpr"), (fp / F.greatest("N", F.lit(1))).alias("fpr"),
        (tp / F.greatest(tp + fp, F.lit(1))).alias("precision"), f1_clamped(tp, fp, fn).alias("f1"),
    )


def best_f1(sweep: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """The sweep's row with the largest F1; of equal ones the lowest threshold."""
    groups = groups or []
    best = F.max_by(F.struct(*[c for c in sweep.columns if c not in groups]), F.struct("f1", -F.col("threshold")))
    return sweep.groupBy(*groups).agg(best.alias("b")).select(*groups, "b.*")


def fpr_constrained(sweep: DataFrame, max_fpr: float, groups: list[str] | None = None) -> DataFrame:
    """The feasible row with the largest TPR, lowest threshold first; no row if none is."""
    groups = groups or []
    fit = sweep.where(F.col("fpr") <= max_fpr)
    best = F.max_by(F.struct(*[c for c in sweep.columns if c not in groups]), F.struct("tpr", -F.col("threshold")))
    return fit.groupBy(*groups).agg(best.alias("b")).where(F.col("b").isNotNull()).select(*groups, "b.*")


def _next_after(x: Column) -> Column:
    """The next double above a positive one, by its exponent and last place."""
    exponent = F.floor(F.log2(x))
    exponent = F.when(F.pow(F.lit(2.0), exponent) > x, exponent - 1).when(F.pow(F.lit(2.0), exponent + 1) <= x, exponent + 1).otherwise(exponent)
    return F.when(x == 0, F.lit(5e-324)).otherwise(x + F.pow(F.lit(2.0), F.greatest(exponent - 52, F.lit(-1074))))


def choose_threshold(rows: DataFrame, max_fpr: float, groups: list[str] | None = None, prob: str = "prob", label: str = "label") -> DataFrame:
    """``(groups, threshold, tpr, fpr)``: of the observed scores, and the number just above
    the largest, the lowest that gives the most TPR with FPR at most ``max_fpr``. A group
    without negatives has no FPR and no row."""
    keys = groups or ["_all"]
    counts = score_counts(rows.withColumn("_all", F.lit(0)), keys, prob, label)
    cum = from_the_top(counts, keys, prob, ["pos", "neg"])
    totals = counts.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.max(prob).alias("top"))
    joined = cum.alias("c").join(totals.alias("t"), [F.col(f"c.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys])
    seen = joined.select(*[F.col(f"c.{k}") for k in keys], F.col(prob).alias("threshold"), ratio(F.col("cum_pos"), F.col("P")).alias("tpr"), ratio(F.col("cum_neg"), F.col("N")).alias("fpr"))
    above = totals.select(*keys, _next_after(F.col("top")).alias("threshold"), ratio(F.lit(0), F.col("P")).alias("tpr"), ratio(F.lit(0), F.col("N")).alias("fpr"))
    fit = seen.unionByName(above).where(F.col("fpr") <= max_fpr + 1e-12)
    best = F.max_by(F.struct("threshold", "tpr", "fpr"), F.struct("tpr", -F.col("threshold")))
    out = fit.groupBy(*keys).agg(best.alias("b")).where(F.col("b").isNotNull()).select(*keys, "b.*")
    return out if groups else out.drop("_all")


def rate_block(rows: DataFrame, hit: Column, groups: list[str] | None = None) -> DataFrame:
    """``(groups, n, k, rate, lower, upper)`` with Wilson bounds."""
    out = rows.groupBy(*(groups or [])).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return out.select("*", ratio(F.col("k"), F.col("n")).alias("rate"), low.alias("lower"), high.alias("upper"))


def confusion_from_rates(summary: DataFrame, groups: list[str], n: str = "n", label: str = "label", tpr: str = "tpr", fpr: str = "fpr") -> DataFrame:
    """Counts rebuilt from each source's size and rate (rounded half to even), and their
    F1, precision and recall."""
    hits = F.bround(F.col(n) * F.coalesce(tpr, F.lit(0.0))).cast("long")
    wrong = F.bround(F.col(n) * F.coalesce(fpr, F.lit(0.0))).cast("long")
    one = F.col(label) == 1
    out = summary.groupBy(*groups).agg(
        F.coalesce(F.sum(F.when(one, hits)), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.when(one, F.col(n) - hits)), F.lit(0)).alias("fn"),
        F.coalesce(F.sum(F.when(~one, wrong)), F.lit(0)).alias("fp"), F.coalesce(F.sum(F.when(~one, F.col(n) - wrong)), F.lit(0)).alias("tn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.select("*", (tp / F.greatest(tp + fp, F.lit(1))).alias("precision"), (tp / F.greatest(tp + fn, F.lit(1))).alias("recall"), f1_clamped(tp, fp, fn).alias("f1"))


def parity(pairs: DataFrame, got: str, want: str, tolerance: float, cut: float = 0.5) -> DataFrame:
    """Adds the absolute error, whether the call flips, and whether the error is tolerated."""
    error = F.abs(F.col(got) - F.col(want))
    return pairs.select("*", error.alias("abs_error"), ((F.col(got) >= cut) != (F.col(want) >= cut)).alias("flip"), (error <= tolerance).alias("within"))


def called(prob: str = "prob", cut: float = 0.5, decision: Column | None = None) -> Column:
    """Whether a row is called: its explicit decision if it has one, else its probability at the cut."""
    by_score = F.col(prob) >= cut
    return by_score if decision is None else F.coalesce(decision, by_score)


def two_conditions(prob: str, rescue: str, cut: float = 0.225, rescue_cut: float = 0.02) -> Column:
    """The operating decision of a score and a second one; null unless both are there."""
    return (F.col(prob) >= cut) & (F.col(rescue) >= rescue_cut)
