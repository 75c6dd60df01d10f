"""The evaluation domain over the given tables, in Spark and in DuckDB SQL.

``cohort``: labelled documents with a made detector score. The score is a hash of the id
blended with the label; about 6 % of rows have none and are failures or missing.
``lines``: the same over line items, for large inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import short_id, unit_hash
from ..storage import importable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def score(key, label, seed: str = "260905", steps: int = 1000):
    return F.floor((0.6 * unit_hash(key, seed) + 0.4 * label) * steps) / steps


def cohort(spark: SparkSession, sf_dir: str, model: str = "260905") -> DataFrame:
    """``track_id, source, lang, n_chars, label, toxic, prob, stage, split, cluster``."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("track_id"), "source", "lang", "n_chars", short_id("text", "c-", 16).alias("cluster"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("track_id"), F.col("quality").alias("label"), "toxic")
    rows = docs.join(labels, "track_id")
    lost, part = unit_hash("track_id", "lost" + model), unit_hash("track_id", "split")
    return rows.select(
        "*", F.when(lost >= 0.06, score("track_id", F.col("label"), model)).alias("prob"),
        F.when(lost < 0.04, "inference").when(lost < 0.06, "missing").alias("stage"),
        F.when(part < 0.3, "calibration").when(part < 0.45, "validation").otherwise("test").alias("split"),
    )


def unit(key: str, seed: str) -> str:
    return f"(('0x' || substr(sha256('{seed}:' || ({key})::varchar), 1, 8))::ubigint / 4294967296.0)"


def cohort_sql(name: str = "cohort", model: str = "260905") -> str:
    lost, part = unit("d.doc_id", "lost" + model), unit("d.doc_id", "split")
    return f"""{name} as (
  select d.doc_id as track_id, d.source, d.lang, d.n_chars, 'c-' || substr(sha256(d.text), 1, 16) as cluster, l.quality as label, l.toxic,
    case when {lost} >= 0.06 then floor((0.6::double * {unit('d.doc_id', model)} + 0.4::double * l.quality) * 1000) / 1000.0::double end as prob,
    case when {lost} < 0.04 then 'inference' when {lost} < 0.06 then 'missing' end as stage,
    case when {part} < 0.3 then 'calibration' when {part} < 0.45 then 'validation' else 'test' end as split
  from documents d join labels l on d.doc_id = l.doc_id)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_id, source, label, prob`` of every line item."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = items.select(key.alias("row_id"), F.concat(F.lit("s"), F.col("l_suppkey") % 20).alias("source"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return rows.withColumn("prob", score("row_id", F.col("label"), steps=100000))


LINES_SQL = f"""lines as (
  select row_id, source, label, floor((0.6::double * {unit('row_id', '260905')} + 0.4::double * label) * 100000) / 100000.0::double as prob
  from (select l_orderkey * 10 + l_linenumber as row_id, 's' || (l_suppkey % 20) as source, (l_returnflag = 'R')::int as label from lineitem))"""


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, so that the order of a sum does not show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounded_sql(sql: str, columns: list[str], doubles: list[str], digits: int = 9) -> str:
    picked = ", ".join(f"round({c}, {digits}) as {c}" if c in doubles else c for c in columns)
    return f"with q as ({sql}) select {picked} from q"
