"""Completed runs, published results and frozen releases: their gates as tables of violations.

A gate returns ``(key, rule)`` rows and passes when there are none. Everything is a join or
a row rule, so a gate over a run of any size is a distributed query; only one-row
summaries are compared as such.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import record_seed, row_sum
from ..functions.texts import safe_relative_path
from .constraints import violations

OUTCOMES = ("scored", "model_execution_error", "input_execution_error")
#: Cuts of the two-condition operating decision (fixed values).
SCORE_CUT, RESCUE_CUT = 0.225, 0.02
MEMBERSHIP = ("label", "source")


def _none(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "key string, rule string")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def membership(rows: DataFrame, manifest: DataFrame, key: str, fields: tuple[str, ...] = MEMBERSHIP) -> DataFrame:
    """Rows that repeat, are not in the manifest, are absent, or differ from it in a field."""
    twice = rows.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.lit("repeated").alias("rule"))
    mine = rows.select(F.col(key).cast("string").alias("a"), *[F.col(f).alias(f"a_{f}") for f in fields])
    theirs = manifest.select(F.col(key).cast("string").alias("b"), *[F.col(f).alias(f"b_{f}") for f in fields])
    both = mine.join(theirs, F.col("a") == F.col("b"), "full_outer")
    inside = F.col("a").isNotNull() & F.col("b").isNotNull()
    rules = [F.when(F.col("b").isNull(), "unlisted"), F.when(F.col("a").isNull(), "absent")]
    rules += [F.when(inside & ~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), f"{f} differs") for f in fields]
    broken = both.select(F.coalesce("a", "b").alias("key"), F.explode(F.array_compact(F.array(*rules))).alias("rule"))
    return twice.unionByName(broken.distinct())


def digests_hold(rows: DataFrame, expected: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows whose digest is not the one a summary has for them."""
    want = expected.select(F.col(key).cast("string").alias("key"), F.col(digest).alias("want"))
    got = rows.select(F.col(key).cast("string").alias("key"), F.col(digest).alias("got"))
    return got.join(want, "key").where(~F.col("got").eqNullSafe(F.col("want"))).select("key", F.lit("digest differs").alias("rule"))


def recounted(rows: DataFrame, claimed: DataFrame, by: str) -> DataFrame:
    """Values of ``by`` whose claimed count ``n`` is not the rows' own."""
    own = rows.groupBy(F.col(by).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("own"))
    both = own.join(claimed.select(F.col(by).cast("string").alias("key"), F.col("n").alias("told")), "key", "full_outer")
    return both.where(~F.col("own").eqNullSafe(F.col("told"))).select("key", F.lit("count differs").alias("rule"))


def completed_run(rows: DataFrame, manifest: DataFrame, summary: DataFrame, outcomes: DataFrame, key: str = "id", digest: str = "digest") -> DataFrame:
    """Gate of a hash-bound run: membership and fields as in the manifest, every record with the
    digest its summary has, and outcomes that add up to the claimed counts."""
    return _union([membership(rows, manifest, key), digests_hold(rows, summary, key, digest), recounted(rows, outcomes, "outcome")])


def record_rules(key: str = "id") -> dict[str, Column]:
    """Rules of one published prediction: probabilities and decisions of scored rows only, plain
    error classes of others, and the seed that follows from the id."""
    scored, failed = F.col("outcome") == "scored", F.col("outcome").isin(*OUTCOMES[1:])
    p, r, said = F.col("prob"), F.col("rescue_prob"), F.col("production_ai")

    def share(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & x.between(0, 1)

    return {
        "outcome is known": F.col("outcome").isin(*OUTCOMES),
        "a score is a probability": ~scored | share(p),
        "a decision follows the cuts": ~scored | r.isNull() | (share(r) & said.eqNullSafe((p >= SCORE_CUT) & (r >= RESCUE_CUT))),
        "a failure has no score": ~failed | (p.isNull() & r.isNull() & said.isNull()),
        "an error class is a name": ~failed | F.col("error_type").rlike("^[A-Za-z][A-Za-z0-9_]*$"),
        "the seed follows from the id": F.col("seed") == record_seed(F.concat(F.lit("260905:"), F.col(key).cast("string"))),
    }


def public_results(rows: DataFrame, manifest: DataFrame, outcomes: DataFrame, columns: set[str], key: str = "id") -> DataFrame:
    """Gate of published predictions: a closed schema, the rules of each record, membership, and
    a recount of the outcomes."""
    extra = sorted(set(rows.columns) ^ columns)
    closed = rows.sparkSession.createDataFrame([(c, "column is not approved or absent") for c in extra], "key string, rule string") if extra else _none(rows)
    return _union([closed, violations(rows, key, record_rules(key)), membership(rows, manifest, key), recounted(rows, outcomes, "outcome")])


def file_digests(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """``(file, n, digest)``: an order-free digest of the rows of each file."""
    return rows.groupBy(F.col(name).cast("string").alias("file")).agg(F.count(F.lit(1)).alias("n"), row_sum(*columns).alias("digest"))


def binding(own: DataFrame, published: DataFrame) -> DataFrame:
    """Files of two tables ``(file, digest)`` that are not the same: a reproduction, a figure's
    inputs or a report's references are bound when there are none."""
    both = own.select(F.col("file").alias("a"), F.col("digest").alias("x")).join(published.select(F.col("file").alias("b"), F.col("digest").alias("y")), F.col("a") == F.col("b"), "full_outer")
    rule = F.when(F.col("b").isNull(), "unlisted").when(F.col("a").isNull(), "missing").when(~F.col("x").eqNullSafe(F.col("y")), "changed")
    return both.select(F.coalesce("a", "b").alias("key"), rule.alias("rule")).where("rule is not null")


def equal_conditions(current: DataFrame, reference: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields of a run's conditions that are not those of its reference run."""
    return membership(current, reference, key, tuple(fields)).where("rule not in ('absent', 'repeated')")


def one_row(summary: DataFrame, key: str, expected: dict[str, object]) -> DataFrame:
    """Fields of a one-row summary that are not as expected (status, scope, replicates ...)."""
    return violations(summary, key, {f"{name} is {value}": F.col(name).eqNullSafe(F.lit(value)) for name, value in expected.items()})


def input_condition(rows: DataFrame, condition: str, key: str = "id") -> DataFrame:
    """Rows that were not made under the final input condition; input failures have none."""
    return violations(rows.where(F.col("outcome") != "input_execution_error"), key, {f"condition is {condition}": F.col("condition") == condition})


def preprocessing_rules(conditions: tuple[str, ...], decoders: dict[str, str | None], rate: int, frames: int) -> dict[str, Column]:
    """Rules of the published struct ``input``: its condition, sizes, levels and decoder's route."""
    x = F.col("input")
    route = F.lit(False)
    for name, error in decoders.items():
        route = route | ((x["decoder"] == name) & x["error_type"].eqNullSafe(F.lit(error)))
    return {
        "condition is known": x["condition"].isin(*conditions),
        "model input is fixed": (x["model_rate"] == rate) & (x["model_frames"] == frames),
        "sizes are positive": (x["rate"] > 0) & (x["channels"] > 0) & (x["frames"] > 0),
        "levels are finite": (x["peak"] >= 0) & (x["rms"] >= 0) & (x["peak"] < float("inf")) & (x["rms"] < float("inf")),
        "digest is a SHA-256": x["sha256"].rlike("^[0-9a-f]{64}$"),
        "the decoder's route is declared": route,
    }


def bundle(listed: DataFrame, present: DataFrame, required: list[str]) -> DataFrame:
    """Gate of a bundle: safe names, well-formed digests, the required files, and exactly the
    listed files with their digests. Tables ``(file, digest)``."""
    rules = {"name stays inside": safe_relative_path("file"), "digest is a SHA-256": F.col("digest").rlike("^[0-9a-f]{64}$")}
    needed = listed.sparkSession.createDataFrame([(r,) for r in required], "file string")
    absent = needed.join(listed.select("file"), "file", "left_anti").select(F.col("file").alias("key"), F.lit("required").alias("rule"))
    return _union([violations(listed, "file", rules), absent, binding(present, listed)])


def relative_names(files: DataFrame, root: str, path: str = "path") -> DataFrame:
    """``file`` of every row: its path below ``root``; a path outside, an unsafe name or two paths
    with one name is an error."""
    prefix = root.rstrip("/") + "/"
    name = F.when(F.col(path).startswith(prefix), F.substring(F.col(path), len(prefix) + 1, 1 << 20))
    named = files.withColumn("file", F.when(F.coalesce(safe_relative_path(name), F.lit(False)), name).otherwise(F.raise_error(F.concat(F.lit("not below the root: "), path)).cast("string")))
    n = named.groupBy("file").agg(F.count(F.lit(1)).alias("_n"))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("one name for two files: "), "file")).cast("string")).otherwise(F.col("file"))
    return named.join(n, "file").withColumn("file", checked).drop("_n")


def rebound(cached: DataFrame, entries: DataFrame, key: list[str], fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Cached evidence under a new selection: the entries that have evidence with the same key and
    equal fields, and ``(key, rule)`` of entries without."""
    mine = entries.select(*key, *[F.col(f).alias(f"_e_{f}") for f in fields])
    both = mine.join(cached, key, "left")
    same = reduce(lambda a, b: a & b, [F.col(f"_e_{f}").eqNullSafe(F.col(f)) for f in fields])
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in key]).alias("key")
    have = cached.select(*key).distinct()
    lost = entries.join(have, key, "left_anti").select(name, F.lit("no evidence").alias("rule"))
    differ = both.join(have, key, "left_semi").where(~same).select(name, F.lit("evidence of other content").alias("rule"))
    return both.join(have, key, "left_semi").where(same).drop(*[f"_e_{f}" for f in fields]), lost.unionByName(differ)


def review_verdicts(pairs: DataFrame, least_ratio: float = 0.98) -> DataFrame:
    """Adds ``verdict`` to reviewed candidate pairs: the same recording, shared material, or not
    confirmed. Columns: confirmed, shared, length_a, length_b, same_original."""
    ratio = F.least("length_a", "length_b") / F.greatest("length_a", "length_b")
    verdict = (
        F.when(F.col("confirmed") & ((ratio >= least_ratio) | F.col("same_original")), "same_recording_or_excerpt")
        .when(F.col("shared") | F.col("confirmed"), "shared_audio_lineage_not_identical_recording").otherwise("not_confirmed_as_shared_audio")
    )
    return pairs.withColumn("verdict", verdict)


def corrected_identity(entries: DataFrame, links: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Entries with the fields of the page link that proves them, and whether that changed any;
    an entry without a link has no evidence."""
    new = links.select(key, *[F.col(f).alias(f"_n_{f}") for f in fields], F.lit(True).alias("_linked"))
    both = entries.join(new, key, "left")
    linked = F.coalesce("_linked", F.lit(False))
    changed = reduce(lambda a, b: a | b, [~F.col(f).eqNullSafe(F.col(f"_n_{f}")) for f in fields])
    evidence = F.when(linked, "exact_page_link")
    kept = [F.when(linked, F.col(f"_n_{f}")).otherwise(F.col(f)).alias(f) for f in fields]
    rest = [c for c in entries.columns if c not in (key, *fields)]
    return both.select(key, *kept, *rest, evidence.alias("source_identity_evidence"), (linked & changed).alias("changed"))


def freeze_gates(entries: DataFrame, validation: DataFrame, conflicts: DataFrame, exposed: DataFrame, candidates: DataFrame, reviewed: DataFrame, key: str = "id") -> DataFrame:
    """Gate of a freeze over its artifacts: every entry validated and with evidence of its identity,
    ids distinct, no group with two labels, no exposed entry, every candidate pair reviewed.
    ``conflicts(group)``, ``exposed(key)``, ``candidates(a, b)``, ``reviewed(a, b)``."""
    name = F.col(key).cast("string").alias("key")
    unvalidated = entries.join(validation.select(key), key, "left_anti").select(name, F.lit("not validated").alias("rule"))
    evidence = entries.where("native and source_identity_evidence is null").select(name, F.lit("no evidence of identity").alias("rule"))
    twice = entries.groupBy(name).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.lit("repeated").alias("rule"))
    labels = conflicts.select(F.col("group").cast("string").alias("key"), F.lit("two labels in a group").alias("rule"))
    known = entries.join(exposed.select(key).distinct(), key, "left_semi").select(name, F.lit("known exposure").alias("rule"))
    open_ = candidates.join(reviewed, ["a", "b"], "left_anti").select(F.concat_ws("/", F.col("a").cast("string"), F.col("b").cast("string")).alias("key"), F.lit("not reviewed").alias("rule"))
    return _union([unvalidated, evidence, twice, labels, known, open_])


def native_inventory(rows: DataFrame, track_exposure: DataFrame, creator_exposure: DataFrame) -> DataFrame:
    """``(track_id, variant_id, creator, reasons, eligible)``: exposure of tracks and creators (any
    letter case) with its reasons. Tables ``(track_id, reason)`` and ``(creator, reason)``."""
    by_track = track_exposure.groupBy("track_id").agg(F.collect_set("reason").alias("x"))
    by_creator = creator_exposure.groupBy(F.lower("creator").alias("c")).agg(F.collect_set("reason").alias("y"))
    both = rows.join(by_track, "track_id", "left").join(by_creator, F.lower(F.col("creator")) == F.col("c"), "left")
    none = F.array().cast("array<string>")
    reasons = F.array_sort(F.array_union(F.coalesce("x", none), F.coalesce("y", none)))
    return both.select("track_id", "variant_id", "creator", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("eligible"))


def verify_leak(rows: DataFrame, counts: DataFrame, seen: str = "seen_in_training", evidence: str = "seen_evidence", key: str = "track_id") -> DataFrame:
    """Gate of a leak report: a boolean for every row, equal to whether there is evidence, and
    per-source counts ``(source, seen, n)`` that a recount gives."""
    rules = {f"{seen} is present": F.col(seen).isNotNull(), f"{seen} agrees with {evidence}": F.col(seen).isNull() | (F.col(seen) == F.col(evidence).isNotNull())}
    pair = F.concat_ws("/", "source", F.col(seen).cast("string"))
    own = rows.withColumn("_pair", pair)
    told = counts.select(F.concat_ws("/", "source", F.col("seen").cast("string")).alias("_pair"), "n")
    return violations(rows, key, rules).unionByName(recounted(own, told, "_pair"))


def verify_production(cohort: DataFrame, lines: DataFrame, scores: DataFrame, failures: DataFrame, key: str = "track_id", path: str = "path") -> DataFrame:
    """Gate of an imported run: raw lines are the cohort's paths once each, every row scored or
    failed and not both, and each score a probability with a decision."""
    wanted, got = cohort.select(F.col(path).alias("key")), lines.groupBy(F.col(path).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    both = wanted.withColumn("c", F.lit(1)).join(got, "key", "full_outer")
    rule = F.when(F.col("c").isNull(), "line outside the cohort").when(F.col("n").isNull(), "no line").when(F.col("n") > 1, "line repeated")
    raw = both.select("key", rule.alias("rule")).where("rule is not null")
    flags = cohort.select(key).withColumn("c", F.lit(1)).join(scores.select(key, "prob", "decision_ai", F.lit(1).alias("s")), key, "full_outer").join(failures.select(key, F.lit(1).alias("f")), key, "full_outer")
    named = F.col(key).cast("string").alias("key")
    rules = [
        F.when(F.col("c").isNull(), "outside the cohort"), F.when(F.col("s").isNotNull() & F.col("f").isNotNull(), "scored and failed"),
        F.when(F.col("s").isNull() & F.col("f").isNull(), "neither scored nor failed"), F.when(F.col("s").isNotNull() & F.col("decision_ai").isNull(), "no decision"),
        F.when(F.col("s").isNotNull() & ~F.coalesce(F.col("prob").between(0, 1), F.lit(False)), "no probability"),
    ]
    return raw.unionByName(flags.select(named, F.explode(F.array_compact(F.array(*rules))).alias("rule")))


def validated(entries: DataFrame, cached: DataFrame, key: str, digest: str, check: Column) -> DataFrame:
    """``(key, ok, reused)`` of every entry: the cached result of the same content, or a new check."""
    old = cached.select(F.col(key).alias("_k"), F.col(digest).alias("_d"), F.col("ok").alias("_ok"))
    both = entries.join(old, (F.col(key) == F.col("_k")) & (F.col(digest) == F.col("_d")), "left")
    reused = F.col("_d").isNotNull()
    return both.select(key, F.when(reused, F.col("_ok")).otherwise(check).alias("ok"), reused.alias("reused"))
