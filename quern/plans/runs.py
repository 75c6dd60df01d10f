"""Whole runs composed of the operators: a detector's report, a frozen analysis, a corpus
plan, a duplicate audit, and their verification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import RANK_SEED, rank_key, short_id
from ..operators import catalogue, constraints, graph, joins, metrics, selection, similarity, summaries
from ..storage import stage


def detector_report(rows: DataFrame, threshold: float = 0.5, max_fpr: float = 0.05) -> dict[str, DataFrame]:
    """Tables of one detector's run over ``(track_id, source, label, prob)``; a null
    probability is a failure. ``sources, gates, sweep, best, constrained, overall``."""
    scored = rows.where(metrics.valid_probability(F.col("prob")))
    gated = rows.withColumn("prob", F.when(metrics.valid_probability(F.col("prob")), F.col("prob")))
    sources = summaries.source_summary(gated, threshold, order="track_id")
    sweep = metrics.threshold_sweep(scored)
    return {
        "sources": sources, "gates": summaries.source_gates(sources), "sweep": sweep, "best": metrics.best_f1(sweep),
        "constrained": metrics.fpr_constrained(sweep, max_fpr), "overall": metrics.point_metrics(scored, threshold),
    }


def frozen_analysis(rows: DataFrame, max_fpr: float = 0.02, calibration: str = "calibration", fixed: float = 0.5) -> DataFrame:
    """Long table ``(model, rule, scope, name, n, tp, tn, fp, fn, tpr, ...)`` of models over
    ``(model, track_id, split, source, grp, label, prob)``.

    Each model's threshold comes from the calibration split alone and is applied to every
    split, source and group, next to the fixed threshold.
    """
    scored = rows.where("prob is not null")
    chosen = metrics.choose_threshold(scored.where(F.col("split") == calibration), max_fpr, ["model"]).select("model", F.col("threshold").alias("t"))
    both = scored.join(F.broadcast(chosen), "model", "left")  # a row for each model
    rules = F.explode(F.array(F.struct(F.lit("calibrated").alias("rule"), F.col("t").alias("t")), F.struct(F.lit("fixed").alias("rule"), F.lit(fixed).alias("t"))))
    cells = both.withColumn("r", rules).select(*[c for c in both.columns if c != "t"], "r.rule", "r.t").where("t is not null")
    scope = F.explode(F.array(*[F.struct(F.lit(s).alias("scope"), F.col(s).cast("string").alias("name")) for s in ("split", "source", "grp")]))
    cells = cells.withColumn("s", scope).select("*", "s.scope", "s.name")
    return metrics.point_metrics(cells, "t", ["model", "rule", "scope", "name"])


def lower_bounds(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Failure-as-error metrics of each model and split at its own threshold."""
    both = rows.join(F.broadcast(thresholds.select("model", F.col("threshold").alias("t"))), "model")
    shifted = both.withColumn("prob", F.when(F.col("prob").isNotNull(), (F.col("prob") >= F.col("t")).cast("double")))
    return metrics.failure_as_error(shifted, 0.5, groups=["model", "split"])


def corpus_plan(members: DataFrame, caps: dict[str, int], tiers: list[dict[str, int]], budget: int, seed: str = RANK_SEED) -> DataFrame:
    """Rows chosen for evaluation and training, with ``role``.

    Evaluation takes up to a cap from each group, clean tracks whose family was also
    transformed first, transforms of chosen clean tracks first. Training takes no family
    and no path of the evaluation.
    """
    # Written once: every group below is drawn from these rows.
    named = stage(catalogue.classified(members.where("type = 'file'")).where("kind in ('human', 'ai')"), "plan-members")
    rows = stage(catalogue.resolved_captions(named), "plan-rows")
    changed = rows.where(~F.col("variant").isin("clean", "co_created")).select("generator", "family").distinct().withColumn("_t", F.lit(True))
    rows = rows.join(changed, ["generator", "family"], "left")
    transform = F.col("group").contains("__")
    rank = [rank_key("family", seed), F.col("path")]

    def taken(part: DataFrame, preferred: Column, cap: int, by: str = "group") -> DataFrame:
        return selection.top_per_group(part, [by], [F.when(preferred, 0).otherwise(1), *rank], cap)

    human = [taken(rows.where(F.col("group") == g), F.lit(False), caps[g]) for g in ("human_jamendo", "human_fma_ood", "co_created")]
    clean = taken(rows.where((F.col("variant") == "clean") & (F.col("kind") == "ai")), F.coalesce("_t", F.lit(False)), caps["clean_per_generator"])
    clean = stage(clean, "plan-clean")
    paired = clean.select("generator", "family").distinct().withColumn("_p", F.lit(True))
    transforms = rows.where(transform).join(paired, ["generator", "family"], "left")
    transforms = taken(transforms, F.coalesce("_p", F.lit(False)), caps["transform_per_generator"]).drop("_p")
    chosen = stage(reduce(DataFrame.unionByName, [*human, clean, transforms]).drop("_t"), "plan-eval")
    pool = rows.drop("_t").join(chosen.select("family").distinct(), "family", "left_anti").join(chosen.select("path"), "path", "left_anti")
    train = selection.budget_fill(pool, tiers, budget, "group", "family", "path", "size", seed)
    return chosen.withColumn("role", F.lit("eval")).unionByName(train.withColumn("role", F.lit("train_pool")))


def runtime_manifest(plan: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose file is on the ledger with the planned size, and those that are missing."""
    got = ledger.select(F.col("path").alias("_p"), F.col("size").alias("_s"), F.col("sha256").alias("audio_sha256"))
    both = plan.join(got, (F.col("path") == F.col("_p")) & (F.col("size") == F.col("_s")), "left").drop("_p", "_s")
    named = both.select(short_id("path", "mb_", 16, "sha1").alias("track_id"), "*")
    return named.where("audio_sha256 is not null"), named.where("audio_sha256 is null")


def evaluation_view(manifest: DataFrame, root: str) -> DataFrame:
    return manifest.where("role = 'eval'").withColumn("runtime_path", F.concat(F.lit(root.rstrip("/") + "/"), F.col("path")))


def duplicate_audit(rows: DataFrame, key: str, digests: list[str], sequence: str | None = None, owners: list[str] | None = None) -> dict[str, DataFrame]:
    """``exact`` copies, ``candidates`` by fingerprint, ``recordings`` and ``clusters`` (which
    also join rows of one owner or lineage), and groups with two labels."""
    named = rows.withColumn("_key", F.col(key).cast("string"))
    links = graph.shared_value_links(named, "_key", digests)
    near = similarity.copy_candidates(named, "_key", sequence) if sequence else None
    if near is not None:
        links = links.union(near.select("a", "b"))
    keys = named.select(F.col("_key").alias("key"))
    recordings = graph.group_labels(keys, links, "recording:")
    wide = links.union(graph.shared_value_links(named, "_key", owners)) if owners else links
    out = {"exact": similarity.exact_copies(named, "_key", digests), "recordings": graph.representatives(recordings), "clusters": graph.group_labels(keys, wide, "cluster:")}
    if near is not None:
        out["candidates"] = near
    if "label" in rows.columns:
        grouped = recordings.select("key", F.col("label").alias("recording")).join(named.select(F.col("_key").alias("key"), "label"), "key")
        out["conflicts"] = constraints.conflicting(grouped, "recording", ["label"])
    return out


def verify_plan(plan: DataFrame, again: DataFrame, caps: dict[str, int]) -> DataFrame:
    """``(check, n)`` of what is wrong with a plan: rows that differ from a second plan,
    families in both roles, groups beyond their cap."""
    a, b = (x.select("path", "role") for x in (plan, again))
    differ = a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.lit("differs").alias("check"), F.count(F.lit(1)).alias("n"))
    families = plan.groupBy("family").agg(F.count_distinct("role").alias("r")).agg(F.lit("family in both roles").alias("check"), F.count_if(F.col("r") > 1).alias("n"))
    cap = F.when(F.col("group").contains("__"), caps["transform_per_generator"]).when(F.col("group").isin("human_jamendo", "human_fma_ood", "co_created"), F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])[F.col("group")]).otherwise(caps["clean_per_generator"])
    over = plan.where("role = 'eval'").groupBy("group").agg(F.count(F.lit(1)).alias("k")).agg(F.lit("over the cap").alias("check"), F.count_if(F.col("k") > cap).alias("n"))
    return differ.unionByName(families).unionByName(over).where("n > 0")


def verify_run(cohort: DataFrame, scores: DataFrame, failures: DataFrame, report: DataFrame, again: DataFrame) -> DataFrame:
    """``(check, n)``: coverage of the cohort, and rows of a report that a recomputation does
    not give."""
    cover = joins.exact_cover(cohort, scores, failures, "track_id").select(F.col("problem").alias("check"), "n")
    same = report.exceptAll(again).unionByName(again.exceptAll(report)).agg(F.lit("report differs").alias("check"), F.count(F.lit(1)).alias("n"))
    return cover.unionByName(same).where("n > 0")


def agreement(first: DataFrame, second: DataFrame, keys: list[str], fields: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Fields of two computations that differ by more than the tolerance, or are null in one."""
    a = first.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields])).alias("x")).select(*keys, "x.*")
    b = second.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("other")) for f in fields])).alias("x")).select(*keys, "x.*")
    both = a.join(b, [*keys, "field"], "full_outer")
    return both.where(~F.col("value").eqNullSafe(F.col("other")) & ~F.coalesce(F.abs(F.col("value") - F.col("other")) <= tolerance, F.lit(False)))
