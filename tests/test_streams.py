from pyspark.sql import types as T

from quern.plans.row_queries import _drain
from quern.streaming import ledger

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("i", T.LongType()), T.StructField("bad", T.BooleanType())])


def write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(path)


def test_latest_equals_batch(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, [("a", 1, False), ("b", 2, True)])
    write(spark, path, [("a", 3, True)])
    got = {r["k"]: r["i"] for r in _drain(spark, ledger.latest(ledger.read_records(spark, path, SCHEMA, files_each=1), "k", "i"), "complete").collect()}
    assert got == {"a": 3, "b": 2}


def test_resume_neither_repeats_nor_skips(spark, tmp_path):
    path, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    for rows in ([("a", 1, False)], [("b", 2, False), ("c", 3, False)]):
        write(spark, path, rows)
        ledger.append_idempotent(ledger.read_records(spark, path, SCHEMA), out, ckpt).awaitTermination()
    assert sorted(r["i"] for r in spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(out).collect()) == [1, 2, 3]


def test_pending(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, [("a", 1, False), ("b", 2, False)])
    done = spark.createDataFrame([("a",)], "k string")
    assert [r["k"] for r in _drain(spark, ledger.pending(ledger.read_records(spark, path, SCHEMA), done, "k"), "append").collect()] == ["b"]


def test_breaker_opens_after_failures_in_a_row(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, [("a", i, i in (1, 2, 3)) for i in range(5)] + [("b", i, i % 2 == 0) for i in range(6)])
    got = {r["key"]: (r["seen"], r["open"]) for r in _drain(spark, ledger.breaker(ledger.read_records(spark, path, SCHEMA), "k", "bad", "i", most=3), "update").collect()}
    assert got == {"a": (5, True), "b": (6, False)}
