import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions.intervals import wilson
from quern.operators import bootstrap, metrics, pairs, summaries
from quern.operators.running import from_the_top

SCORES = "label int, prob double, g string"


def frame(spark, rows):
    return spark.createDataFrame([(int(l), float(p), "g") for l, p in rows], SCORES)


def auroc(rows):
    pos, neg = [p for l, p in rows if l], [p for l, p in rows if not l]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def average_precision(rows):
    p = sum(l for l, _ in rows)
    total = before = 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        tp = sum(l for l, s in rows if s >= t)
        total += (tp - before) / p * tp / sum(s >= t for _, s in rows)
        before = tp
    return total


def test_threshold_of_a_small_calibration_set(spark):
    rows = frame(spark, [(0, 0.1), (0, 0.2), (1, 0.7), (1, 0.9)])
    r = metrics.choose_threshold(rows, 0.0).first()
    assert (r["threshold"], r["tpr"], r["fpr"]) == (0.7, 1.0, 0.0)


def test_threshold_above_all_scores(spark):
    rows = frame(spark, [(1, 0.2), (0, 0.9), (0, 0.9)])
    r = metrics.choose_threshold(rows, 0.0).first()
    assert r["threshold"] == math.nextafter(0.9, math.inf) and r["tpr"] == 0.0
    assert metrics.choose_threshold(frame(spark, [(1, 0.5)]), 0.1).count() == 0


@pytest.mark.parametrize("x", [1.0, 0.5, 0.1, 0.999999, 1e-300, 0.75, 0.3])
def test_next_after(spark, x):
    assert spark.range(1).select(metrics._next_after(F.lit(x)).alias("y")).first()["y"] == math.nextafter(x, math.inf)


def test_failures_count_as_errors(spark):
    rows = spark.createDataFrame([(0, 0.1), (1, 0.9), (1, None), (0, None)], "label int, prob double")
    r = metrics.failure_as_error(rows, 0.5).first()
    assert (r["tp"], r["tn"], r["fp"], r["fn"], r["n_attempted"], r["n_scored"]) == (1, 1, 1, 1, 4, 2) and "auroc" not in r


@pytest.mark.parametrize("seed", range(3))
def test_rank_metrics_equal_their_definitions(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(rng.integers(2)), round(float(rng.random()), 1 if seed else 3)) for _ in range(200)]
    r = metrics.rank_metrics(frame(spark, rows).repartition(5), ["g"]).first()
    assert r["auroc"] == pytest.approx(auroc(rows), abs=1e-12) and r["auprc"] == pytest.approx(average_precision(rows), abs=1e-12)


def test_ties_and_single_class(spark):
    rows = [(1, 0.3), (1, 0.7), (1, 0.7), (1, 0.9), (0, 0.1), (0, 0.7), (0, 0.4)]
    assert metrics.rank_metrics(frame(spark, rows), ["g"]).first()["auroc"] == pytest.approx(auroc(rows))
    r = metrics.point_metrics(frame(spark, [(1, 0.9), (1, 0.2)]), 0.5).first()
    assert r["auroc"] is None and r["fpr"] is None and r["balanced_accuracy"] is None and r["tpr"] == 0.5


def test_sweep_equals_counting(spark):
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(2)), float(p)) for p in np.r_[rng.random(100), np.arange(201) * 0.005, np.linspace(0, 1, 201)]]
    found = {round(r["threshold"] / 0.005): r for r in metrics.threshold_sweep(frame(spark, rows)).collect()}
    assert len(found) == 201
    for i in range(201):
        t = i * (1.0 / 200)
        assert (found[i]["tp"], found[i]["fp"]) == (sum(l == 1 and p >= t for l, p in rows), sum(l == 0 and p >= t for l, p in rows))
    best = metrics.best_f1(metrics.threshold_sweep(frame(spark, rows))).first()
    top = max(r["f1"] for r in found.values())
    assert best["threshold"] == min(r["threshold"] for r in found.values() if r["f1"] == top)


def test_probability_gate(spark):
    rows = spark.createDataFrame([(x,) for x in (-0.1, 1.1, float("nan"), float("inf"), None, 0.0, 1.0, 0.5)], "prob double")
    ok, failed = metrics.split_failures(rows)
    assert ok.count() == 3 and failed.count() == 5 and {r["stage"] for r in failed.collect()} == {"inference"}


@pytest.mark.parametrize("k,n", [(5, 10), (0, 0), (0, 20), (20, 20)])
def test_wilson(spark, k, n):
    low, high = wilson(F.lit(k), F.lit(n))
    r = spark.range(1).select(low.alias("a"), high.alias("b")).first()
    want = {(5, 10): (0.2366, 0.7634), (0, 20): (0.0, 0.1611), (20, 20): (0.8389, 1.0)}.get((k, n))
    assert (r["a"], r["b"]) == (None, None) if want is None else (r["a"], r["b"]) == pytest.approx(want, abs=1e-3)


def test_source_summary_keeps_failures(spark):
    rows = spark.createDataFrame([("s", 0.4, 1), ("s", 0.8, 1), ("s", None, 1), ("t", None, 0)], "source string, prob double, label int")
    found = {r["source"]: r for r in summaries.source_summary(rows, 0.7).collect()}
    assert (found["s"]["n"], found["s"]["failures"], found["s"]["attempted"], found["s"]["tpr"]) == (2, 1, 3, 0.5)
    assert found["t"]["n"] == 0 and found["t"]["prob_mean"] is None and found["t"]["fpr"] is None


def test_gates_and_regressions(spark):
    schema = "source string, label int, tpr double, fpr double"
    now = spark.createDataFrame([("a", 1, 0.8, None), ("b", 0, None, 0.06), ("c", 0, None, 0.05), ("aime_stable_audio_v1", 1, 0.7, None)], schema)
    assert {r["source"] for r in summaries.source_gates(now).collect()} == {"a", "b"}
    then = spark.createDataFrame([("a", 1, 0.9, None), ("b", 0, None, 0.05), ("c", 0, None, 0.0)], schema)
    assert {r["source"] for r in summaries.regressions(now, then).collect()} == {"a", "c"}


def test_running_totals_over_bands(spark):
    rng = np.random.default_rng(2)
    values = sorted({round(float(x), 4) for x in rng.random(500)})
    df = spark.createDataFrame([("a" if i % 3 else "b", v, i) for i, v in enumerate(values)], "k string, v double, n long").repartition(4)
    found = from_the_top(df, ["k"], "v", ["n"], bands=16).collect()
    for r in found:
        assert r["cum_n"] == sum(i for i, v in enumerate(values) if ("a" if i % 3 else "b") == r["k"] and v >= r["v"])


def entries(spark):
    rows = [(1, "ai", "s1", 0, 0.9), (2, "ai", "s2", 0, 0.2), (3, "ai", "s1", 1, 0.8), (4, "ai", "s2", 2, None), (5, "real", "r", 3, 0.1), (6, "real", "r", 4, 0.7), (7, "real", "r", 5, 0.3), (8, "real", "q", 6, 0.5)]
    return spark.createDataFrame([(i, int(l == "ai"), s, f"c{c}", p, f"{l}|{s}") for i, l, s, c, p in rows], "id long, label int, source string, cluster string, prob double, cell string")


def test_clusters_are_drawn_whole_in_joined_strata(spark):
    found = bootstrap.cluster_strata(entries(spark)).collect()
    strata = {}
    for r in found:
        strata.setdefault(r["stratum"], set()).add(r["cluster"])
    assert strata["ai|s1"] == {"c0", "c1", "c2"} and strata["real|r"] == {"c3", "c4", "c5"} and strata["real|q"] == {"c6"}
    pairs = [(r["cluster"], r["cell"]) for r in entries(spark).collect()]
    assert {k: set(v) for k, v in bootstrap._members(pairs).items()} == strata
    weights = bootstrap.bootstrap_weights(entries(spark), 50).toPandas()
    assert weights.equals(bootstrap.bootstrap_weights(entries(spark), 50).toPandas())
    sums = weights.assign(s=weights.cluster.map({c: s for s, cs in strata.items() for c in cs})).groupby(["replicate", "s"]).w.sum().unstack()
    assert (sums["ai|s1"] == 3).all() and (sums["real|r"] == 3).all() and (sums["real|q"] == 1).all()


def test_weights_by_hash_where_clusters_are_many(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "DRIVER_DRAWS", 100)
    many = spark.range(400).select(F.concat(F.lit("c"), "id").alias("cluster"), F.lit("x").alias("cell"))
    w = bootstrap.bootstrap_weights(many, 50).agg(F.sum("w").alias("s"), F.max("w").alias("m")).first()
    assert abs(w["s"] / (400 * 50) - 1) < 0.05 and w["m"] <= 12


def test_strata_keep_their_size_where_clusters_are_many(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "DRIVER_DRAWS", 100)
    many = spark.range(300).select(F.concat(F.lit("c"), "id").alias("cluster"), F.when(F.col("id") < 3, "a").when(F.col("id") < 40, "b").otherwise("c").alias("cell"))
    linked = many.union(spark.createDataFrame([("c2", "b")], "cluster string, cell string"))
    for rows, sizes in ((many, {"a": 3, "b": 37, "c": 260}), (linked, {"a": 40, "c": 260})):
        weights = bootstrap.bootstrap_weights(rows, 40).join(bootstrap.cluster_strata(rows), "cluster")
        sums = weights.groupBy("replicate", "stratum").agg(F.sum("w").alias("s")).collect()
        assert len(sums) == 40 * len(sizes) and all(r["s"] == sizes[r["stratum"]] for r in sums)


def test_weights_follow_the_generator():
    members = {"a": ["x", "y", "z"], "b": ["u"]}
    drawn = bootstrap.draw_weights(members, 20, 7)
    rng = np.random.default_rng(7)
    picked = rng.integers(0, 3, size=(20, 3))
    got = drawn[drawn.cluster.isin(["x", "y", "z"])].pivot(index="replicate", columns="cluster", values="w").fillna(0)
    assert np.array_equal(got.to_numpy(), np.stack([(picked == i).sum(axis=1) for i in range(3)], axis=1))


def test_weighted_auroc(spark):
    labels, scores, weights = [1, 0, 1, 0, 1, 0], [0.5, 0.5, 0.9, 0.1, 0.2, 0.9], [1, 2, 0, 3, 1, 1]
    rows = [(l, s) for l, s, w in zip(labels, scores, weights) for _ in range(w)]
    counts = spark.createDataFrame([("g", s, float(l * w), float((1 - l) * w)) for l, s, w in zip(labels, scores, weights)], "g string, prob double, pos double, neg double").groupBy("g", "prob").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    assert bootstrap.weighted_auroc(counts, ["g"]).first()["AUROC"] == pytest.approx(auroc(rows))


def test_failed_rows_lower_coverage_only(spark):
    rows = spark.createDataFrame([(1, "a", 0.9, 1), (0, "b", 0.1, 1), (1, "a", None, 1)], "label int, source string, prob double, w int").withColumn("g", F.lit(0))
    r = bootstrap.metric_rows(rows, ["g"]).first()
    assert r["F1"] == 1 and r["AUROC"] == 1 and r["coverage"] == pytest.approx(2 / 3)


def test_same_model_differs_by_nothing(spark):
    rows = entries(spark)
    found = bootstrap.paired_difference(rows, rows, bootstrap.bootstrap_weights(rows, 30), "id", 30).collect()
    assert found and all(r["estimate"] in (None, 0) and r["lower"] in (None, 0) and r["upper"] in (None, 0) for r in found)


def test_equal_values_have_a_point_interval(spark):
    rows = entries(spark).withColumn("value", F.lit(0.1))
    r = bootstrap.summarize_values(rows, bootstrap.bootstrap_weights(rows, 40), 40).first()
    assert r["estimate"] == pytest.approx(0.1) and r["lower"] == pytest.approx(0.1) and r["upper"] == pytest.approx(0.1)


def test_mixed_lineage_is_an_error():
    import pandas as pd

    with pytest.raises(ValueError):
        bootstrap.lineage_bootstrap(pd.DataFrame({"lineage": ["a", "a"], "label": [0, 1], "prob": [0.1, 0.9]}), 0.5, 2)


def test_four_view_contrast(spark):
    t = spark.createDataFrame([("x", 0.4, 0.7, 0.5, 0.9), ("y", 0.4, None, 0.5, 0.9)], "id string, f double, s double, cf double, cs double")
    assert pairs.interaction(t, "f", "s", "cf", "cs").where("id = 'x'").first()["interaction"] == pytest.approx(0.1)
    found = {(r["first"], r["second"]): r for r in pairs.pair_summary(t, [("f", "s"), ("s", "cs"), ("f", "cf")]).collect()}
    assert found["f", "s"]["signed_shift"] == pytest.approx(0.3) and found["f", "s"]["attempted"] == 2 and found["f", "s"]["complete"] == 1
    assert found["f", "s"]["flips"] == 1 and found["s", "cs"]["flips"] == 0 and found["f", "cf"]["absolute_shift"] == pytest.approx(0.1)


def _stream(members, replicates, seed):
    """The weights as one run of NumPy's stream, independently of the module's parcels."""
    rng, out = np.random.default_rng(seed), {}
    for _, clusters in sorted(members.items()):
        names = sorted(clusters)
        for r, row in enumerate(rng.integers(0, len(names), size=(replicates, len(names)))):
            for i in row:
                out[r, names[i]] = out.get((r, names[i]), 0) + 1
    return out


@pytest.mark.parametrize("few", [True, False])
def test_parcels_follow_one_stream_and_the_driver_keeps_none(spark, monkeypatch, few):
    monkeypatch.setattr(bootstrap, "PARCEL_DRAWS", 70)
    if not few:
        monkeypatch.setattr(bootstrap, "DRIVER_DRAWS", 100)
    monkeypatch.setattr(bootstrap, "draw_weights", lambda *a: pytest.fail("all weights on the driver"))
    rows = [(f"c{i}", "b" if i % 3 else "a") for i in range(120)] + [("éa", "a"), ("z", "y"), ("z", "x"), ("w", "x"), ("one", "o")]
    members = {"a": [c for c, k in rows if k == "a"], "b": [c for c, k in rows if k == "b"], "x": ["z", "w"], "o": ["one"]}
    drawn = bootstrap.bootstrap_weights(spark.createDataFrame(rows, "cluster string, cell string"), 30, hashed=False).collect()
    assert {(r["replicate"], r["cluster"]): r["w"] for r in drawn} == _stream(members, 30, bootstrap.SEED) and len(drawn) == len(set((r["replicate"], r["cluster"]) for r in drawn))


def test_lineage_draws_are_neither_shuffled_nor_stored(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(bootstrap, "stage", lambda df, name, f=bootstrap.stage: staged.append(name) or f(df, name))
    rows = spark.range(300).select(F.concat(F.lit("c"), F.col("id") % 100).alias("lineage"), (F.col("id") % 100 < 40).cast("int").alias("label"), (F.col("id") % 7 / 7.0).alias("prob"))
    weights = bootstrap.bootstrap_weights(rows, 50, cluster="lineage", cell="label", hashed=True).withColumnRenamed("cluster", "lineage").toPandas()
    staged.clear()
    found = {r["metric"]: (r["lower"], r["upper"]) for r in bootstrap.lineage_intervals(rows, 0.5, 50).collect()}
    both = rows.toPandas().merge(weights, on="lineage")
    hit = both[both.prob >= 0.5]
    for name, label in (("tpr", 1), ("fpr", 0)):
        rate = hit[hit.label == label].groupby("replicate").w.sum() / both[both.label == label].groupby("replicate").w.sum()
        assert found[name] == pytest.approx(tuple(np.quantile(rate, [0.025, 0.975])))
    assert "bootstrap-weights" not in staged
