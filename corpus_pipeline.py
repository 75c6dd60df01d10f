"""The corpus pipeline: quality rules, near duplicates, decontamination, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that the stage before kept,
and returns a DataFrame that is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import packing, quality_rules, secrets, simhash, winnowing
from quern.llm._store import prepare, stage, table
from quern.llm.queries import byte_bpe_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level quality rules reject go."""
    return quality_rules.keep_passed(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 that with the smallest id stays."""
    return simhash.keep_one_each(docs, shingle_words=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark go."""
    return winnowing.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; ``n_chars`` follows the text."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of each document, with its place in a sequence."""
    return packing.pack_documents(docs, byte_bpe_path(), capacity=1024, end_id=0)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_duplicates", near_duplicates),
    ("winnowing_decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("sum_of_squares_packing", packing_stage),
]

#: Fingerprints, token ids and pattern spans have no SQL here; tests hold every stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; the last one's rows."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
    return docs
