import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quern.functions import nested
from quern.operators import joins, releases, scoring
from quern.sources import manifests, sinks


def keys(df):
    return sorted((r["key"], r["rule"]) for r in df.collect())


@pytest.fixture(scope="module")
def manifest(spark):
    return spark.createDataFrame([(i, i % 2, "s") for i in range(6)], "id long, label int, source string")


def test_whole_run_passes_and_changes_are_found(spark, manifest):
    run = manifest.withColumn("outcome", F.lit("scored")).withColumn("digest", F.concat(F.lit("d"), "id"))
    claimed = spark.createDataFrame([("scored", 6)], "outcome string, n long")
    assert keys(releases.completed_run(run, manifest, run, claimed)) == []
    wrong = run.where("id <> 5").withColumn("label", F.when(F.col("id") == 1, 7).otherwise(F.col("label"))).unionByName(run.where("id = 2"))
    found = keys(releases.completed_run(wrong, manifest, run.withColumn("digest", F.when(F.col("id") != 3, F.col("digest"))), claimed))
    assert found == [("1", "label differs"), ("2", "repeated"), ("3", "digest differs"), ("5", "absent")]


def test_record_rules_take_nulls_and_nans(spark):
    schema = "id long, outcome string, prob double, rescue_prob double, production_ai boolean, error_type string, seed long"
    seed = scoring.entry_seed(F.col("id"))
    rows = spark.createDataFrame([
        (1, "scored", 0.5, None, None, None, 0), (2, "scored", float("nan"), None, None, None, 0), (3, "scored", None, None, None, None, 0),
        (4, "model_execution_error", None, None, None, "ValueError", 0), (5, "model_execution_error", 0.2, None, None, "../x", 0), (6, "lost", None, None, None, None, 0),
        (7, "scored", 0.3, 0.5, True, None, 0), (8, "scored", 0.3, 0.01, True, None, 0),
    ], schema).withColumn("seed", seed)
    from quern.operators.constraints import violations

    assert keys(violations(rows, "id", releases.record_rules())) == [
        ("2", "a score is a probability"), ("3", "a score is a probability"), ("5", "a failure has no score"), ("5", "an error class is a name"),
        ("6", "outcome is known"), ("8", "a decision follows the cuts"),
    ]


def test_closed_schema(spark, manifest):
    rows = manifest.withColumn("secret", F.lit("x")).withColumn("outcome", F.lit("scored"))
    for c, t in (("prob", "double"), ("rescue_prob", "double"), ("production_ai", "boolean"), ("error_type", "string")):
        rows = rows.withColumn(c, F.lit(0.5 if c == "prob" else None).cast(t))
    rows = rows.withColumn("seed", scoring.entry_seed(F.col("id")))
    claimed = spark.createDataFrame([("scored", 6)], "outcome string, n long")
    assert keys(releases.public_results(rows, manifest, claimed, set(rows.columns) - {"secret"})) == [("secret", "column is not approved or absent")]


def test_relative_names_refuse_what_leaves_the_root(spark):
    files = spark.createDataFrame([("/r/a/b.py",), ("/r/c.py",)], "path string")
    assert sorted(r["file"] for r in releases.relative_names(files, "/r").collect()) == ["a/b.py", "c.py"]
    for bad in ("/q/a.py", "/r/../x", "/r/"):
        with pytest.raises(PySparkException):
            releases.relative_names(spark.createDataFrame([(bad,)], "path string"), "/r").collect()


def test_attached_field_must_be_there(spark):
    rows, fields = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, True)], "k long, seen boolean")
    with pytest.raises(PySparkException):
        joins.attached_field(rows, fields, "k", "seen").collect()


def test_frozen_rows_must_agree(spark, manifest):
    assert manifests.read_frozen(manifest, manifest, ["label"]).count() == 6
    for wrong in (manifest.where("id > 0"), manifest.withColumn("label", F.lit(9))):
        with pytest.raises(PySparkException):
            manifests.read_frozen(manifest, wrong, ["label"]).collect()


def test_isolated_rows(spark):
    rows = spark.createDataFrame([(1, 0), (2, 3), (3, 4)], "id long, k long")
    found = {r["id"]: r for r in scoring.score_isolated(rows, "slow_or_broken", "id", 1.0).collect()}
    assert found[1]["prob"] == 0.5 and found[2]["error_type"] == "TimeoutExpired" and found[3]["outcome"] == "input_execution_error"
    assert found[2]["error"] == scoring.timeout_error(1.0) and len({r["seed"] for r in found.values()}) == 3


def test_archives(spark):
    members = {"b/x.txt": b"1", "a.txt": b"2"}
    assert sinks.zip_bytes(members) == sinks.zip_bytes(dict(reversed(members.items()))) and sinks.unzip_bytes(sinks.zip_bytes(members)) == members
    for name in ("../x", "/x", "a//b", "a\\b"):
        with pytest.raises(ValueError):
            sinks.unzip_bytes(sinks.zip_bytes({name: b""}))
    with pytest.raises(ValueError):
        sinks.unzip_bytes(sinks.zip_bytes({"a": b"x" * 100}), most=99)
    files = spark.createDataFrame([("k", "a/1", "x"), ("k", "b", "y"), ("l", "c", "z")], "bundle string, file string, content string")
    packed = sinks.bundled(files)
    assert {(r["bundle"], r["file"], bytes(r["content"])) for r in sinks.extracted(packed).collect()} == {("k", "a/1", b"x"), ("k", "b", b"y"), ("l", "c", b"z")}


def test_clip_and_song_records():
    clip = {"id": "m", "model_name": "x", "major_model_version": "v4", "handle": "h", "metadata": {"duration": 3}}
    assert nested.clip_record([clip, dict(clip), {"id": "m"}], "m")["generator_version"] == "v4"
    assert nested.clip_record([clip, dict(clip, handle="i")], "m")["error"].startswith("conflicting")
    assert nested.clip_record([{"id": "m"}], "m")["error"].startswith("no clip")
    badge = dict(clip, metadata={"model_badges": {"songcard": {"display_name": "v5"}}})
    assert nested.clip_record([badge], "m")["error"] == "conflicting version evidence"
    song = {"song_path": "https://h/x/m?q=1", "generation_id": "g", "modelVersion": "u1"}
    assert nested.song_record([song], "m")["generator_version"] == "u1" and "error" in nested.song_record([dict(song, song_path="https://h/xm")], "m")


def test_a_key_named_twice_is_an_error(spark):
    ok = spark.createDataFrame([('{"a": "1", "b": "2"}',)], "t string").select(nested.string_map("t").alias("m")).first()["m"]
    assert ok == {"a": "1", "b": "2"}
    with pytest.raises(PySparkException):
        spark.createDataFrame([('{"a": "1", "a": "2"}',)], "t string").select(nested.string_map("t")).collect()


def test_numbered_rows_need_no_single_task(spark):
    from quern.operators.selection import stride

    rows = spark.range(0, 1000).select(F.col("id"), F.xxhash64("id").alias("h"))
    want = [r["id"] for r in rows.orderBy("h").collect()][::7]
    assert sorted(r["id"] for r in stride(rows, [F.col("h")], 7).collect()) == sorted(want)


def test_links_of_equal_values_are_stars(spark):
    from quern.operators.similarity import block_links

    rows = spark.createDataFrame([(i, 5) for i in range(40)] + [(100, 4), (101, -1)], "k long, x long")
    found = {(r["a"], r["b"], r["distance"]) for r in block_links(rows, "k", "x").collect()}
    assert found == {(0, i, 0) for i in range(1, 40)} | {(0, 100, 1)}


def test_digest_of_a_large_file(spark):
    """The sum of 48-bit digests of so many rows needs more than 63 bits."""
    import hashlib

    rows = spark.range(70_000).select(F.lit("f").alias("file"), "id")
    whole = sum(int(hashlib.sha256(str(i).encode()).hexdigest()[:12], 16) for i in range(70_000))
    small = sum(int(hashlib.sha256(str(i).encode()).hexdigest()[:12], 16) for i in range(100))
    r = releases.file_digests(rows, "file", ["id"]).first()
    assert whole >= 1 << 63 and r["n"] == 70_000 and r["digest"] == (whole + (1 << 63)) % (1 << 64) - (1 << 63)
    assert releases.file_digests(rows.where("id < 100"), "file", ["id"]).first()["digest"] == small
    assert dict(releases.file_digests(rows, "file", ["id"]).dtypes)["digest"] == "bigint"


def test_time_limits_run_out_together(spark):
    """One after the other these rows would take 40 seconds in one task."""
    import time

    import pandas as pd

    rows = [(pd.DataFrame({"id": [i], "k": [3 if i % 2 else 4 * (i % 4 == 0)]}), i) for i in range(80)]
    began = time.monotonic()
    found = scoring._all_isolated(scoring.REGISTRY["slow_or_broken"], rows, 1.0, 32)
    assert time.monotonic() - began < 20
    kinds = [r[2] for r in found]
    assert kinds == ["TimeoutExpired" if i % 2 else "OSError" if i % 4 == 0 else None for i in range(80)]
    assert all(r[0] == 0.5 for r in found if r[2] is None)

    class Computes(scoring.SlowOrBrokenScorer):
        def score(self, batch):
            until = time.process_time() + 0.4
            while time.process_time() < until:
                pass
            return [0.5]

    # Side by side on one processor these would be over their limit.
    import os
    cores = os.sched_getaffinity(0)
    try:
        os.sched_setaffinity(0, {min(cores)})
        assert [r[1] for r in scoring._all_isolated(Computes, [rows[1]] * 8, 2.0, 32)] == ["scored"] * 8
    finally:
        os.sched_setaffinity(0, cores)
    df = spark.createDataFrame([(i, 0) for i in range(40)], "id long, k long").coalesce(1)
    assert scoring.score_isolated(df, "slow_or_broken", "id", 5.0).where("prob = 0.5").count() == 40
