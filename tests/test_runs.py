import random

from pyspark.sql import functions as F

from quern.plans import base, render, runs

CAPS = {"human_jamendo": 5, "human_fma_ood": 5, "co_created": 4, "clean_per_generator": 6, "transform_per_generator": 3}
TIERS = [{"magnet": 8}, {"human_jamendo": 50, "human_fma_ood": 50}]


def members(spark):
    random.seed(3)
    paths = [f"Jamendo/Song {i} - Artist.mp3" for i in range(30)] + [f"OOD FMA/{i}.mp3" for i in range(30)]
    paths += [f"magnet_generated_music/jamendo/Song {i} - Artist.wav" for i in range(20)] + [f"suno_generated_music/s{i}.wav" for i in range(12)]
    paths += [f"aac_generated_music/magnet_generated_music/jamendo/Song {i} - Artist_aac64.wav" for i in range(0, 20, 2)]
    paths += [f"pgd_generated_music/magnet_generated_music/adv_Song {i} - Artist.wav" for i in range(5)]
    paths += [f"ai_human_co-created_music/jamendo/Song {i} - Artist_edited.mp3" for i in range(10)] + ["Caption/a.csv", "x.txt"]
    return spark.createDataFrame([(p, "file", "s0", i * 1024, random.randrange(10, 90)) for i, p in enumerate(paths)], "path string, type string, shard string, data_offset long, size long")


def test_plan_keeps_caps_and_families(spark):
    rows = members(spark)
    plan = runs.corpus_plan(rows, CAPS, TIERS, 900).cache()
    again = runs.corpus_plan(rows.repartition(7), CAPS, TIERS, 900)
    assert runs.verify_plan(plan, again, CAPS).count() == 0
    other = runs.corpus_plan(rows, CAPS, TIERS, 900, seed="other")
    assert runs.verify_plan(plan, other, CAPS).where("check = 'differs'").count() == 1
    counts = {(r["role"], r["group"]): r["n"] for r in plan.groupBy("role", "group").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts["eval", "human_jamendo"] == 5 and counts["eval", "magnet"] == 6 and counts["eval", "magnet__aac"] == 3
    assert plan.where("role = 'train_pool'").agg(F.sum("size")).first()[0] <= 900
    clean = {r["family"] for r in plan.where("role = 'eval' and `group` = 'magnet'").collect()}
    assert {r["family"] for r in plan.where("`group` = 'magnet__aac'").collect()} <= clean
    ledger = plan.limit(10).select("path", "size", F.lit("h").alias("sha256"))
    got, missing = runs.runtime_manifest(plan, ledger)
    assert got.count() == 10 and got.count() + missing.count() == plan.count() and got.first()["track_id"].startswith("mb_")


def test_detector_report_and_rendering(spark, sf):
    rows = base.cohort(spark, sf)
    report = runs.detector_report(rows)
    text = render.detector_markdown("model", report)
    assert text.startswith("# model") and "## Sources" in text and "| source |" in text
    assert len(render.curve(report["sweep"])) == 201
    assert render.tex("a_b & 5%") == r"a\_b \& 5\%" and render.percent(None) == "–" and render.number(None) == "--"
    assert r"\hline" in render.tex_table(report["best"], ["threshold"])


def test_frozen_analysis_calibrates_on_its_split_alone(spark, sf):
    rows = base.cohort(spark, sf).select(F.lit("m").alias("model"), "track_id", "split", "source", F.col("lang").alias("grp"), "label", "prob")
    found = runs.frozen_analysis(rows, 0.05)
    assert {r["rule"] for r in found.select("rule").distinct().collect()} == {"calibrated", "fixed"}
    changed = rows.withColumn("prob", F.when(F.col("split") != "calibration", 1 - F.col("prob")).otherwise(F.col("prob")))
    t = [runs.metrics.choose_threshold(x.where("split = 'calibration' and prob is not null"), 0.05).first()["threshold"] for x in (rows, changed)]
    assert t[0] == t[1]
    assert runs.agreement(found, found, ["model", "rule", "scope", "name"], ["tpr", "f1", "auroc"]).count() == 0
    shifted = found.withColumn("tpr", F.col("tpr") + 1e-6)
    assert runs.agreement(found, shifted, ["model", "rule", "scope", "name"], ["tpr"]).count() > 0
    bounds = runs.lower_bounds(rows, spark.createDataFrame([("m", 0.5)], "model string, threshold double"))
    assert all(r["n_attempted"] == r["n_scored"] + r["n_failed"] for r in bounds.collect())


def test_duplicate_audit(spark):
    rows = spark.createDataFrame([(1, "h1", "o1", 1), (2, "h1", "o2", 0), (3, "h2", "o2", 0), (4, "h3", None, 1)], "id long, h string, owner string, label int")
    found = runs.duplicate_audit(rows, "id", ["h"], owners=["owner"])
    assert found["exact"].count() == 1 and found["conflicts"].count() == 1
    assert found["recordings"].select("label").distinct().count() == 3 and found["clusters"].select("label").distinct().count() == 2
    assert found["recordings"].where("representative").count() == 3


def test_verify_run(spark):
    ids = spark.range(5).withColumnRenamed("id", "track_id")
    report = spark.createDataFrame([("a", 1)], "k string, v int")
    assert runs.verify_run(ids, ids.where("track_id < 3"), ids.where("track_id >= 3"), report, report).count() == 0
    assert runs.verify_run(ids, ids.where("track_id < 3"), ids.where("track_id > 3"), report, report.withColumn("v", F.lit(2))).count() == 2
