"""Manifests, scores, cohorts and references from JSON and TSV files."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import rank_key
from ..functions.nested import string_map
from ..functions.texts import fold_text, leading_number
from ..functions.urls import identity_kind

#: Row lists that a manifest may have, and the splits of a lineage manifest (fixed values).
ROW_LISTS = ("bench", "tracks")
LEGACY_SPLITS = ("train", "test")
ALL_SPLITS = ("train", "val", "test", "bench")
LINEAGE_SPLITS = ("train", "val", "test", "hardneg", "codec_cells", "rows", "tracks", "items")
LINEAGE_FIELDS = ("path", "track_id", "origin_path", "origin_track_id", "source_path")

SCORES = T.StructType([T.StructField("track_id", T.StringType()), T.StructField("source", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("prob", T.DoubleType()), T.StructField("decision_ai", T.BooleanType())])
FAILURES = T.StructType([T.StructField(n, T.StringType()) for n in ("track_id", "source", "stage", "error_type", "error")])


def _document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)


def _rows(doc: DataFrame, name: str) -> DataFrame:
    return doc.select(F.posexplode(name).alias("ordinal", "r")).select("ordinal", "r.*")


def read_manifest(spark: SparkSession, path: str, split: str | None = None, bench_origin: str | None = None, protocol_split: str | None = None, key: str = "track_id") -> DataFrame:
    """Rows of a manifest in any of its three layouts, with ``ordinal``.

    A row list under ``bench`` or ``tracks`` is read whole and filtered by its own columns;
    only the layout of ``train`` and ``test`` lists heeds ``split``. A row without the key
    is an error.
    """
    doc = _document(spark, path)
    found = next((n for n in ROW_LISTS if n in doc.columns), None)
    if found:
        rows = _rows(doc, found)
    else:
        splits = [s for s in LEGACY_SPLITS if s in doc.columns and split in (None, "all", s)]
        if not splits:
            raise ValueError(f"no row list in {path}")
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_rows(doc, s).withColumn("split", F.lit(s)) for s in splits])
    for column, value in (("bench_origin", bench_origin), ("protocol_split", protocol_split)):
        if value is not None:
            rows = rows.where(F.col(column) == value) if column in rows.columns else rows.where(F.lit(False))
    if key not in rows.columns:
        raise ValueError(f"no row of {path} has {key}")
    return rows.withColumn(key, F.coalesce(F.col(key), F.raise_error(F.lit(f"a row has no {key}")).cast("string")))


def audit_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows for an audit: the first of ``bench``, ``tracks`` and ``test`` that is there."""
    doc = _document(spark, path)
    name = next((n for n in (*ROW_LISTS, "test") if n in doc.columns), None)
    if name is None:
        raise ValueError(f"no row list in {path}")
    return _rows(doc, name)


def keyed_rows(rows: DataFrame, key: str = "track_id", ordinal: str = "ordinal") -> DataFrame:
    """One row for each key that is not empty: the last one wins."""
    found = rows.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    rest = [c for c in rows.columns if c != key]
    return found.groupBy(key).agg(F.max_by(F.struct(*rest), ordinal).alias("r")).select(key, "r.*")


def split_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all four splits with their split's name."""
    doc = _document(spark, path)
    parts = [_rows(doc, s).withColumn("split", F.lit(s)) for s in ALL_SPLITS if s in doc.columns]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(SCORES).json(path)


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(FAILURES).json(path)


def decisions(scores: DataFrame) -> DataFrame:
    """Explicit decisions, if every score has one; else no rows."""
    whole = scores.agg(F.coalesce(F.bool_and(F.col("decision_ai").isNotNull()), F.lit(False)).alias("_whole"))
    return scores.join(F.broadcast(whole)).where("_whole").select("track_id", "decision_ai")  # one row


def read_cohort(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a cohort file, a list or ``{"track_ids": [...]}``; empty or repeated ids are errors."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("t"))
    ids = F.when(F.col("t").startswith("["), F.from_json("t", "array<string>")).otherwise(F.from_json("t", "track_ids array<string>")["track_ids"])
    ok = F.coalesce((F.size(ids) > 0) & (F.size(F.array_distinct(ids)) == F.size(ids)), F.lit(False))
    return text.select(F.explode(F.when(ok, ids).otherwise(F.raise_error(F.lit("a cohort is a list of distinct ids")))).alias("track_id"))


def read_title_index(spark: SparkSession, path: str) -> DataFrame:
    """``(title, artist, id)`` of a TSV with TRACK_ID, TRACK_NAME and ARTIST_NAME; short rows are left out."""
    rows = spark.read.option("sep", "\t").option("header", True).option("mode", "DROPMALFORMED").csv(path)
    number = F.substring_index("TRACK_ID", "_", -1).try_cast("long")
    return rows.where("TRACK_NAME is not null and ARTIST_NAME is not null").select(fold_text("TRACK_NAME").alias("title"), fold_text("ARTIST_NAME").alias("artist"), number.alias("id"))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Leading numbers of names in a text list, or in a JSON list of names or of records."""
    if path.endswith(".json"):
        text = spark.read.text(path, wholetext=True)
        items = text.select(F.explode(F.from_json("value", "array<string>")).alias("v"))
        record = F.from_json("v", "filename string, filepath string, path string")
        names = items.select(F.when(F.col("v").startswith("{"), F.coalesce(record["filename"], record["filepath"], record["path"])).otherwise(F.col("v")).alias("name"))
    else:
        names = spark.read.text(path).select(F.trim("value").alias("name"))
    return names.select(leading_number("name").alias("id")).where("id is not null").distinct()


def read_lineage(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(manifest, kind, id)`` of every identity that lineage manifests name."""
    parts = []
    for path in paths:
        doc = _document(spark, path)
        lists = [n for n in LINEAGE_SPLITS if n in doc.columns and isinstance(doc.schema[n].dataType, T.ArrayType)]
        if not lists:
            raise ValueError(f"{path}: no rows")
        for name in lists:
            rows = _rows(doc, name)
            values = F.array(*[F.col(f).cast("string") for f in LINEAGE_FIELDS if f in rows.columns])
            named = rows.select(F.explode(values).alias("v")).select(F.lit(path).alias("manifest"), identity_kind("v").alias("k")).where("k is not null")
            parts.append(named.select("manifest", F.substring_index("k", ":", 1).alias("kind"), F.substring_index("k", ":", -1).alias("id")))
    return reduce(DataFrame.unionByName, parts).distinct()


def write_manifest(rows: DataFrame, path: str, name: str = "bench", order: str = "track_id") -> None:
    """One JSON document with the rows under ``name``, in order; for lists that a single document holds."""
    ordered = F.array_sort(F.collect_list(F.struct(order, *[c for c in rows.columns if c != order])))
    rows.agg(F.to_json(F.struct(ordered.alias(name)), {"ignoreNullFields": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_rows(rows: DataFrame, path: str, order: str = "track_id") -> None:
    """One JSON list of the rows, in order, as score and failure files are."""
    ordered = F.array_sort(F.collect_list(F.struct(order, *[c for c in rows.columns if c != order])))
    rows.agg(F.to_json(ordered, {"ignoreNullFields": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_run(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Scores and failures of a run's folder, with no need of its manifest."""
    return read_scores(spark, f"{folder}/track_probs.json"), read_failures(spark, f"{folder}/inference_failures.json")


def read_results(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Scores of several runs with their ``model``; a run that is not there is left out."""
    parts = []
    for model, path in paths.items():
        try:
            parts.append(read_scores(spark, path).withColumn("model", F.lit(model)))
        except AnalysisException:
            continue
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], T.StructType([*SCORES.fields, T.StructField("model", T.StringType())]))


def read_frozen(local: DataFrame, public: DataFrame, fields: list[str], key: str = "id", seed: str = "260905") -> DataFrame:
    """Local rows of a frozen release with their place in rank order. A row that only one side has,
    or that differs in a field, is an error."""
    theirs = public.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_p_{f}") for f in fields])
    both = local.join(theirs, F.col(key) == F.col("_k"), "full_outer")
    same = reduce(lambda a, b: a & b, [F.col(f).eqNullSafe(F.col(f"_p_{f}")) for f in fields], F.col(key).isNotNull() & F.col("_k").isNotNull())
    checked = F.when(same, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("local and public rows differ: "), F.coalesce(F.col(key), F.col("_k")).cast("string"))).cast("string"))
    rows = both.withColumn(key, checked.cast(local.schema[key].dataType)).select(*local.columns)
    return rows.withColumn("rank", rank_key(key, seed))


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """``(id, path)`` of a JSON object; a key that is named twice is an error."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(string_map("value")).alias("id", "path"))


def identity_sets(lineage: DataFrame) -> DataFrame:
    """``(kind, n)`` distinct identities of each kind over all manifests."""
    return lineage.groupBy("kind").agg(F.count_distinct("id").alias("n"))


def read_references(spark: SparkSession, config: dict) -> DataFrame:
    """``(kind, id)`` of training references: a pool of id lists by kind, or lineage manifests."""
    if "lineage" in config:
        return read_lineage(spark, config["lineage"]).select("kind", "id").distinct()
    parts = [read_id_list(spark, path).select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id")) for kind, path in config["pool"].items()]
    return reduce(DataFrame.unionByName, parts)
